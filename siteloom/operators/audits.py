"""Whole audits: captured pages into an audit store, its issues and score, the comparison with the last audit of the domain.

An audit runs in tiers: tables from the markup first, rules and aggregates over the written tables next, comparison last; each tier reads what
the one before has written.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.materialize import materialize, release, written
from . import capture, compare, issues, store
from .schemas import TABLES

#: What an audit keeps of its tables.
KEPT = ("fx_pages", "fx_links", "fx_headings", "fx_images", "fx_structured", "fx_hreflang", "fx_pagination", "fx_resources", "fx_sitemap", "fx_status")


def with_audit(df: DataFrame, audit_id: str) -> DataFrame:
    return df.withColumn("audit_id", F.lit(audit_id))


def responses_of(spark: SparkSession, pages_dir: str) -> DataFrame | None:
    """The responses that were captured beside the pages (``responses.parquet``), if any were."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{pages_dir}/responses.parquet")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{pages_dir}/responses.parquet") if there else None


def run_audit(spark: SparkSession, pages_dir: str, path: str, domain: str, audit_id: str, now: datetime | None = None, start: str | None = None) -> dict:
    """Audit the captured pages of ``pages_dir`` (``pages.parquet``, and ``responses.parquet`` if it is there) into the store at ``path``; id, number of pages, issues by severity and score.

    Depths count from ``start``, by default from the root of each host.

    Running an audit again replaces its rows, so one that was lost half-way can be repeated.
    """
    s, before = store.Store(spark, path), written(spark)
    parsed = materialize(capture.parse(spark.read.parquet(f"{pages_dir}/pages.parquet")), "parsed")
    for name, rows in capture.tables(parsed, responses_of(spark, pages_dir), start).items():
        s.replace(name.removeprefix("fx_"), with_audit(rows, audit_id))
    t = stored_tables(s, audit_id)
    s.replace("issues", with_audit(issues.all_issues(t, domain), audit_id))
    counts = {r["severity"]: r["n"] for r in s.scan("issues", audit_id).groupBy("severity").agg(F.count("*").alias("n")).collect()}
    pages = s.scan("pages", audit_id).count()
    score = max(0.0, 100.0 - 2.0 * counts.get("critical", 0) - 0.5 * counts.get("warning", 0))
    moment = (now or datetime.now(timezone.utc)).replace(tzinfo=None)
    s.replace("audits", spark.createDataFrame([(audit_id, domain, "completed", moment, pages, score, "{}")], "audit_id string, domain string, status string, started_at timestamp_ntz, pages long, health_score double, config string"))
    release(spark, [x for x in written(spark) if x not in before])
    return {"audit_id": audit_id, "domain": domain, "pages": pages, "issues": counts, "health_score": score}


def stored_tables(s: store.Store, audit_id: str) -> dict[str, DataFrame]:
    return {name: s.scan(name.removeprefix("fx_"), audit_id, f"{TABLES[name]}, audit_id string").drop("audit_id") for name in KEPT}


def compare_audits(s: store.Store, base: str, other: str) -> DataFrame:
    """The changes between two audits' pages."""
    pages = lambda a: s.scan("pages", a)
    return compare.diff(pages(base), pages(other))


def run_and_compare(spark: SparkSession, pages_dir: str, path: str, domain: str, audit_id: str, now: datetime | None = None) -> dict:
    """A scheduled run: find the last completed audit of the domain, audit, compare, and say whether it got worse."""
    s = store.Store(spark, path)
    try:
        last = store.previous_audit(s.scan("audits"), domain, audit_id).select(F.col("audit_id").cast("string"), "health_score").first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None  # the first audit of this store
    result = run_audit(spark, pages_dir, path, domain, audit_id, now) | {"baseline": last and last["audit_id"], "alert": None}
    if last:
        result["alert"] = compare.regression_alert(compare_audits(s, last["audit_id"], audit_id), last["health_score"], result["health_score"]).first().asDict()
    return result


def report(s: store.Store, audit_id: str, domain: str) -> str:
    """The audit's page for reading."""
    from . import exports, report as reports

    t = stored_tables(s, audit_id)
    found = s.scan("issues", audit_id)
    sections = {
        "Overview": reports.overview(t["fx_pages"], t["fx_links"]), "Issues": issues.issue_groups(found).orderBy(*issues.ISSUE_SORTS["severity"]()[:1], F.desc("n"), "issue_type"),
        "Scores": reports.scores(reports.page_tests(t["fx_pages"]).unionByName(reports.site_tests(t, found))).orderBy("category"), "Slowest": reports.slowest(t["fx_pages"]), "Largest": reports.slowest(t["fx_pages"], "html_size"),
    }
    return exports.html_report(f"Audit of {domain}", sections)
