"""Snapshot comparison: one full outer join, changes in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FIELDS = ("status_code", "title", "meta_description", "h1", "canonical", "is_indexable")
PAGERANK_SHIFT, SCORE_DROP = 5.0, 5.0


def diff(base: DataFrame, other: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "url", keep: int | None = None) -> DataFrame:
    """url, change (added, removed or the changed field), before and after, as text; trimmed texts are compared.

    ``keep`` limits the rows of each kind of change, by URL order, where a report wants it; nothing is cut by default.
    """
    text = lambda s, c: F.trim(F.coalesce(F.col(f"{s}.{c}").cast("string"), F.lit("")))
    b, o = base.select(key, *fields).alias("b"), other.select(key, *fields).alias("o")
    j = b.join(o, F.col(f"b.{key}") == F.col(f"o.{key}"), "full_outer")
    one = lambda kind, x, y: F.struct(F.lit(kind).alias("change"), x.alias("before"), y.alias("after"))
    both = F.col(f"b.{key}").isNotNull() & F.col(f"o.{key}").isNotNull()
    changes = [F.when(F.col(f"b.{key}").isNull(), one("added", F.lit(""), F.lit(""))), F.when(F.col(f"o.{key}").isNull(), one("removed", F.lit(""), F.lit("")))]
    changes += [F.when(both & (text("b", c) != text("o", c)), one(c, text("b", c), text("o", c))) for c in fields]
    out = j.select(F.coalesce(F.col(f"b.{key}"), F.col(f"o.{key}")).alias(key), F.explode(F.array_compact(F.array(*changes))).alias("_c")).select(key, "_c.*")
    if keep is None:
        return out
    from pyspark.sql import Window

    return out.withColumn("_n", F.row_number().over(Window.partitionBy("change").orderBy(key))).where(F.col("_n") <= keep).drop("_n")


def rank_shifts(base: DataFrame, other: DataFrame, key: str = "url", least: float = PAGERANK_SHIFT) -> DataFrame:
    """Pages whose score moved by ``least`` or more."""
    j = base.select(key, F.col("internal_pagerank").alias("before")).join(other.select(key, F.col("internal_pagerank").alias("after")), key)
    return j.withColumn("shift", F.round(F.col("after") - F.col("before"), 2)).where(F.abs("shift") >= least)


def regression_alert(changes: DataFrame, score_before: float, score_after: float) -> DataFrame:
    """One row: FAIL on new errors or a score drop, WARN on removed or deindexed pages, else PASS."""
    num = lambda c: F.col(c).try_cast("int")
    a = changes.agg(
        F.count_if((F.col("change") == "status_code") & (num("after") >= 400) & (num("before") < 400)).alias("new_errors"),
        F.count_if(F.col("change") == "removed").alias("removed"),
        F.count_if((F.col("change") == "is_indexable") & (F.col("before") == "true")).alias("deindexed"),
    ).withColumn("score_change", F.lit(round(score_after - score_before, 1)))
    return a.withColumn("status", F.when((F.col("new_errors") > 0) | (F.col("score_change") < -SCORE_DROP), "FAIL").when((F.col("removed") > 0) | (F.col("deindexed") > 0), "WARN").otherwise("PASS"))
