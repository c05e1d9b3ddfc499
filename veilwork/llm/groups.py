"""Groups of linked texts: connected components of links, and the rows that stay of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import durable, sieve


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for the nodes of ``edges`` (a, b) by star contraction; root is the smallest node of the component."""
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            break
        before = state
        # Large star: every larger neighbour of a node goes to the smallest one in sight.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(low, F.col("u") == F.col("w")).select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = durable(small.select("e.u", "e.v").where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def with_components(docs: DataFrame, distinct: DataFrame, edges: DataFrame, id: str) -> DataFrame:
    """Rows (id, h, fp, root, component_id) of ``docs`` (id, h, fp), where ``edges`` (a, b) link the prints of ``distinct`` (fp, least).

    ``root`` names the group; component_id is the smallest id in it, which is null only if all are.
    """
    found = components(edges)
    linked = distinct.join(found, F.col("fp") == F.col("node")).select("fp", "root", "least")
    roots = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.select("fp", "root").join(roots, "root").select("fp", "root", "component")
    alone = distinct.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component"))
    whole = durable(alone.unionByName(linked))
    return docs.join(whole, "fp").select(F.col("id").alias(id), "h", "fp", "root", F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, found: DataFrame, id: str, text: str) -> DataFrame:
    """Of each group in ``found`` (id, h, root) the row of ``docs`` with the smallest id, then text hash, with all its columns.

    Rows are told apart by id and text, so two texts of one id are two rows; of rows with equal id and text one stays. Rows without
    an id stay. Texts are not shuffled but for those whose hash a sieve of those in question lets through.
    """
    found = durable(found.where(F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col("h").alias("_h"), "root"))
    several = found.groupBy("root").agg(F.min(F.struct("_id", "_h")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = durable(found.join(several, "root").select("_id", "_h", (F.struct("_id", "_h") == F.col("first")).alias("stays")).distinct())
    # The row as one value, so that no name of its columns can clash.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("h"))
    own = own.withColumn("met", F.col("id").isNotNull() & sieve(F.xxhash64("id", "h"), members.select(F.xxhash64("_id", "_h").alias("key"))))
    dropped = members.where(~F.col("stays"))
    met = own.where("met").join(dropped, (F.col("id") == F.col("_id")) & (F.col("h") == F.col("_h")), "left_anti")
    return own.where(~F.col("met")).select("row.*").unionByName(met.dropDuplicates(["id", "h"]).select("row.*"))
