"""The audit store as Parquet tables partitioned by audit: scans, upserts, frontier and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


class Store:
    """Tables below one folder; an audit is a partition, so its scans and its removal touch its files only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("audit_id").parquet(f"{self.path}/{table}")

    def replace(self, table: str, rows: DataFrame) -> None:
        """Write the audits that ``rows`` holds anew and leave the others."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("audit_id").parquet(f"{self.path}/{table}")

    def scan(self, table: str, audit_id: str | None = None, schema: str | None = None, **equal) -> DataFrame:
        """Rows of an audit with optional equality conditions, which reach the files' statistics. A table that may hold no rows needs its ``schema``."""
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        d = reader.parquet(f"{self.path}/{table}")
        if audit_id is not None:
            d = d.where(F.col("audit_id") == audit_id)
        for column, value in equal.items():
            if value is not None:
                d = d.where(F.col(column) == value)
        return d

    def delete_audit(self, table: str, audit_id: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/audit_id={audit_id}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Old and new rows with one for each key: the new one, of several the largest ``version``.

    Built as one aggregation of structs, so a key's rows are never held together.
    """
    columns = old.columns
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.struct("_new", *([version] if version else []))
    rest = [c for c in columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*").select(*columns)


def upsert_audit(audits: DataFrame, new: DataFrame, key: str = "audit_id", config: str = "config") -> DataFrame:
    """Audits with new values of one or more of them; a configuration of ``{}`` keeps the old one."""
    j = audits.alias("o").join(new.alias("n"), key, "full_outer")
    pick = lambda c: F.coalesce(F.nullif(F.col(f"n.{c}"), F.lit("{}")), F.col(f"o.{c}")) if c == config else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return j.select(key, *[pick(c).alias(c) for c in audits.columns if c != key]).select(*audits.columns)


def list_audits(audits: DataFrame, limit: int = 50) -> DataFrame:
    """The last audits, newest first."""
    return audits.orderBy(F.desc("started_at"), F.desc("audit_id")).limit(limit)


def count_rows(rows: DataFrame, audit_id: str | None = None, status: str | None = None) -> DataFrame:
    """The number of an audit's rows, of one status where that is asked for."""
    if audit_id is not None:
        rows = rows.where(F.col("audit_id") == audit_id)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    return rows.agg(F.count("*").alias("n"))


def claim(frontier: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The next batch and the frontier with that batch marked as processing, so that no other worker takes it."""
    batch = next_batch(frontier, limit)
    return batch, with_status(frontier, batch.select("url", F.lit("processing").alias("status")))


def insert_new(frontier: DataFrame, found: DataFrame, key: str = "url") -> DataFrame:
    """The found rows whose key the frontier doesn't hold, once each: the one with the smallest depth."""
    rest = [c for c in found.columns if c != key]
    once = found.groupBy(key).agg(F.min(F.struct("depth", *[c for c in rest if c != "depth"])).alias("_r")).select(key, "_r.*")
    return once.join(frontier.select(key), key, "left_anti").select(*found.columns)


def next_batch(frontier: DataFrame, limit: int) -> DataFrame:
    """What a crawler takes next: pending rows by depth and id. Spark plans it as a top-k."""
    return frontier.where("status = 'pending'").orderBy("depth", "id").limit(limit)


def with_status(frontier: DataFrame, marks: DataFrame) -> DataFrame:
    """The frontier with new statuses of the marked URLs."""
    return frontier.join(marks.select("url", F.col("status").alias("_s")), "url", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def previous_audit(audits: DataFrame, domain: str, before: str | None = None) -> DataFrame:
    """The last completed audit of a domain."""
    d = audits.where((F.col("domain") == domain) & (F.col("status") == "completed"))
    return (d if before is None else d.where(F.col("audit_id") != before)).orderBy(F.desc("started_at"), F.desc("audit_id")).limit(1)


def expand(rows: DataFrame, key: str, value: str, order: str, prefix: str, most: int = 10) -> DataFrame:
    """The first values of each key as columns prefix-1 to prefix-most: one aggregation, no pivot scan."""
    listed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_l"))
    at = lambda k: F.try_element_at("_l", F.lit(k))[value].alias(f"{prefix}-{k}")
    return listed.select(key, *[at(k) for k in range(1, most + 1)])


def first_by(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))

