"""Findings and what is reported of them. A finding holds a proof and a hash and never the secret."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import durable


def with_types(matches: DataFrame, types: DataFrame) -> DataFrame:
    """Rows of ``matches`` with ``raw_label`` of their secret, ``unknown`` where none is given."""
    return matches.join(types.select("secret", "raw_label"), "secret", "left").withColumn("raw_label", F.coalesce("raw_label", F.lit("unknown")))


def findings(typed: DataFrame, id: str = "doc_id") -> DataFrame:
    """Rows (id, type, proof, secret_hash, hits, redactable, low_signal) from (id, secret, raw_label, hits)."""
    label = X.short_label(F.col("raw_label"))
    rest = [c for c in typed.columns if c not in (id, "secret", "raw_label", "hits")]
    return typed.select(
        id,
        *rest,
        label.alias("type"),
        X.proof(F.col("secret"), F.col("raw_label")).alias("proof"),
        X.secret_hash(F.col("secret")).alias("secret_hash"),
        F.col("hits").cast("long").alias("hits"),
        X.is_high_precision(label).alias("redactable"),
        X.is_low_signal(label).alias("low_signal"),
    )


def file_stats(found: DataFrame, *keys: str) -> DataFrame:
    strong = ~F.col("low_signal")
    return found.groupBy(*keys).agg(
        F.count_if(strong).alias("credential_findings"),
        F.coalesce(F.sum(F.when(strong, F.col("hits"))), F.lit(0)).alias("credential_hits"),
        F.sum("hits").alias("hits"),
    )


def rollup(found: DataFrame, *keys: str, id: str = "doc_id") -> DataFrame:
    """Documents, findings, hits and different secrets by ``keys``."""
    return found.groupBy(*keys).agg(
        F.count_distinct(id).alias("files"), F.count(F.lit(1)).alias("findings"), F.sum("hits").alias("hits"), F.count_distinct("secret_hash").alias("secrets")
    )


def target_rollup(docs: DataFrame, found: DataFrame, source: str, id: str = "doc_id") -> DataFrame:
    """Documents scanned and flagged of each source and their share in percent."""
    flagged = docs.join(found.select(id).distinct(), id, "left_semi").groupBy(source).agg(F.count(F.lit(1)).alias("flagged"))
    scanned = docs.groupBy(source).agg(F.count(F.lit(1)).alias("scanned"))
    out = scanned.join(flagged, source, "left").withColumn("flagged", F.coalesce("flagged", F.lit(0).cast("long")))
    return out.withColumn("share", F.coalesce(F.try_divide(100.0 * F.col("flagged"), F.col("scanned")), F.lit(0.0)))


def top_exposed(found: DataFrame, n: int = 5, id: str = "doc_id") -> DataFrame:
    """The documents with most different secrets, then most hits, with the proof of the most frequent one."""
    best = F.max_by("proof", F.struct((~F.col("low_signal")).cast("int"), "hits", "proof"))
    return found.groupBy(id).agg(F.count_distinct("secret_hash").alias("secrets"), F.sum("hits").alias("hits"), best.alias("proof")).orderBy(F.desc("secrets"), F.desc("hits"), id).limit(n)


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``df`` with places from 1 in ``order``, which must be total: ranges are numbered on their own, behind the counts of those before."""
    parts = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in parts.groupBy("_part").count().orderBy("_part").collect():  # a row a partition
        offsets += [F.lit(r["_part"]), F.lit(before)]
        before += r["count"]
    if not offsets:
        return parts.select(*df.columns, F.lit(0).cast("long").alias(name))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.select(*df.columns, (inside + F.element_at(F.create_map(*offsets), F.col("_part"))).cast("long").alias(name))


def report_order(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """Documents by the order of the report, with ``place`` from 1."""
    return numbered(file_stats(found, id), [F.desc("credential_findings"), F.desc("credential_hits"), F.desc("hits"), F.asc(id)])


def report_sources(found: DataFrame, source: str = "source", id: str = "doc_id") -> DataFrame:
    """Sources by files, with the credential-like findings and hits in them; files whose findings all say little count as files."""
    out = file_stats(found, source, id).groupBy(source).agg(
        F.count(F.lit(1)).alias("files"), F.sum("credential_findings").alias("findings"), F.sum("credential_hits").alias("hits")
    )
    return out.orderBy(F.desc("files"), source)


def report_patterns(found: DataFrame, n: int = 20, id: str = "doc_id") -> DataFrame:
    """The ``n`` credential-like types in most files, then with most hits."""
    rows = found.where(~F.col("low_signal")).groupBy("type").agg(F.count_distinct(id).alias("files"), F.sum("hits").alias("hits"))
    return rows.orderBy(F.desc("files"), F.desc("hits"), F.lower("type"), "type").limit(n)


def in_file_order(typed: DataFrame, id: str = "doc_id") -> DataFrame:
    """Rows (id, secret, raw_label, hits) with their ``place`` in a document: by raw label, then by the secret's hash."""
    order = Window.partitionBy(id).orderBy("raw_label", X.secret_hash(F.col("secret")))
    return typed.withColumn("place", F.row_number().over(order).cast("long"))


def preserved(found: DataFrame, managed: str = "managed") -> tuple[DataFrame, DataFrame]:
    """Findings in files that may be rewritten, and those in managed files, which are reported and kept."""
    return found.where(~F.col(managed)), found.where(F.col(managed))


def first_of_each(found: DataFrame, n: int, id: str = "doc_id") -> DataFrame:
    """The first ``n`` findings of each document and how many more there are."""
    w = Window.partitionBy(id)
    order = w.orderBy(F.desc("hits"), F.lower("type"), "proof")
    out = found.withColumns({"place": F.row_number().over(order), "all": F.count(F.lit(1)).over(w)}).where(F.col("place") <= n)
    return out.withColumn("more", F.greatest(F.col("all") - n, F.lit(0))).drop("all")
