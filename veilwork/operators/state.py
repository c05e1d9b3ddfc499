"""State between runs: what was scanned, snapshots before rewriting, and what is kept of old ones."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fingerprint(version: str, detectors: dict[str, str]) -> str:
    """Changes when a detector does; what older ones found clean is scanned again."""
    return hashlib.sha256(json.dumps({"version": version, "detectors": detectors}, sort_keys=True).encode()).hexdigest()


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def current(cache: DataFrame, mark: str) -> DataFrame:
    """The rows of the cache that the present detectors made."""
    return cache.where(F.col("fingerprint") == mark)


def needs_scan(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files without a row of equal path, modification time, size and digest."""
    return files.join(cache.select("path", "mtime_ns", "size", "digest"), ["path", "mtime_ns", "size", "digest"], "left_anti")


def mark_clean(cache: DataFrame, clean: DataFrame) -> DataFrame:
    """The cache with rows of ``clean`` in place of older ones of their paths."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(clean.select(*cache.columns).withColumn("_new", F.lit(1)))
    newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("_new"), F.desc("cached_at")))
    return both.withColumn("_r", newest).where("_r = 1").drop("_r", "_new")


def invalidate(cache: DataFrame, paths: DataFrame) -> DataFrame:
    return cache.join(paths.select("path").distinct(), "path", "left_anti")


# Snapshots -----------------------------------------------------------------------------------------------------------


def _key(spark: SparkSession, key: str) -> DataFrame:
    """The key as a table of one row, which is broadcast: as a literal it would stand in plans, event logs and the web page."""
    import pyarrow as pa

    rows = pa.table({"_one": pa.array([1], pa.int32()), "_key": pa.array([bytes.fromhex(key)], pa.binary())})
    return F.broadcast(spark.createDataFrame(rows))


def snapshot(df: DataFrame, changed: DataFrame, id: str, path: str, key: str | None = None) -> None:
    """Write the rows that are about to change, whole: with a key, all columns but ``id`` encrypted as one JSON value."""
    rows = df.join(changed.select(id).distinct(), id, "left_semi")
    if key is not None:
        whole = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
        rows = rows.select(id, whole.alias("_row"), F.lit(1).alias("_one")).join(_key(df.sparkSession, key), "_one")
        rows = rows.select(id, F.base64(F.aes_encrypt(F.col("_row").cast("binary"), F.col("_key"), F.lit("GCM"))).alias("_row"))
    rows.write.mode("errorifexists").parquet(path)


def restore(spark: SparkSession, df: DataFrame, path: str, id: str, key: str | None = None) -> DataFrame:
    """``df`` with the text of every row that the snapshot holds as it was."""
    old = spark.read.parquet(path)
    if key is not None:
        plain = F.aes_decrypt(F.unbase64("_row"), F.col("_key"), F.lit("GCM")).cast("string")
        old = old.withColumn("_one", F.lit(1)).join(_key(spark, key), "_one").select(id, F.from_json(plain, "text string")["text"].alias("text"))
    return put_back(df, old.select(id, "text"), id)


def put_back(df: DataFrame, old: DataFrame, id: str) -> DataFrame:
    kept = old.select(F.col(id).alias("_id"), F.col("text").alias("_old"), F.lit(True).alias("_held"))
    out = df.join(kept, F.col(id) == F.col("_id"), "left")
    return out.withColumn("text", F.when(F.col("_held"), F.col("_old")).otherwise(F.col("text"))).drop("_id", "_old", "_held")


def backup_entries(names: DataFrame) -> DataFrame:
    """Rows (tool, name, created, partial, encrypted) of well-formed names ``yyyyMMdd-HHmmss[.partial].tar.gz[.enc]``."""
    m = r"^(\d{8}-\d{6})(\.partial)?\.tar\.gz(\.enc)?$"
    out = names.withColumn("created", F.try_to_timestamp(F.regexp_extract("name", m, 1), F.lit("yyyyMMdd-HHmmss")))
    out = out.where(F.col("created").isNotNull())
    return out.withColumns({"partial": F.regexp_extract("name", m, 2) != "", "encrypted": F.regexp_extract("name", m, 3) != ""})


def known_backups(names: DataFrame, targets: DataFrame) -> DataFrame:
    """Well-formed backups of the given targets, with their root, newest first; those of other tools are not listed."""
    found = backup_entries(names).join(F.broadcast(targets.select("tool", "root", "ordinal")), "tool")  # a fixed registry
    first = found.groupBy("tool", "name", "created", "partial", "encrypted").agg(F.min_by("root", "ordinal").alias("root"))
    return first.orderBy(F.desc("created"), "tool", F.desc("name"))


def stale_logs(logs: DataFrame, keep: int = 30) -> DataFrame:
    """Of log files (name, modified) those to delete: all summaries, and what is older than the newest ``keep`` reports and ``keep`` logs."""
    name = F.col("name")
    kind = F.when(F.rlike(name, F.lit(r"^scan-.*-summary\.txt$")), "summary").when(F.rlike(name, F.lit(r"^scan-.*\.txt$")), "report").when(F.endswith(name, F.lit(".log")), "log")
    rows = logs.withColumn("_kind", kind).where("_kind is not null")
    place = F.row_number().over(Window.partitionBy("_kind").orderBy(F.desc("modified"), F.desc("name")))
    return rows.withColumn("_place", place).where((F.col("_kind") == "summary") | (F.col("_place") > keep)).drop("_kind", "_place")


def newest(entries: DataFrame, n: int, *keys: str) -> DataFrame:
    """The newest ``n`` of each group; what is not among them is to be deleted."""
    return entries.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("created"), F.desc("name")))).where(F.col("_r") <= n).drop("_r")


def restore_points(entries: DataFrame) -> DataFrame:
    """One row a run, newest first."""
    points = entries.groupBy("created").agg(F.sort_array(F.collect_set("tool")).alias("tools"), F.max("partial").alias("partial"))
    return points.orderBy(F.desc("created"))


def age(created: Column, now: Column) -> Column:
    """In whole days of 24 hours."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(created)) / 86400)
    return F.when(days == 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit("d ago")))


def to_back_up(flagged: DataFrame, databases: DataFrame, files: DataFrame) -> DataFrame:
    """Paths to save before a rewrite: flagged texts, databases (path, redactions) with hits, and their side files that exist."""
    hit = databases.where("redactions > 0").select("path")
    beside = hit.select(F.explode(F.array(F.concat("path", F.lit("-wal")), F.concat("path", F.lit("-shm")))).alias("path"))
    return flagged.select("path").union(hit).union(beside.join(files.select("path"), "path", "left_semi")).distinct()
