r"""Mixing sources to target weights by entropy balancing.

Among all rates r(d) in [0, cap] that give each source its target of tokens, entropy balancing takes those closest to 1: it
minimises the sum of q(d) (r log r - r + 1) subject to sum(size r) = target. z(d) being the document's size band (number of binary
digits of its size) over the source's token-weighted mean band, the reference weight is q = size / z, which makes the rates of the
Lagrangian exponential tilts

    r(d) = min(cap, exp(lambda[source] * z(d))).

The convex dual has one multiplier a source. Gradient and Hessian are sums over bands, so one distributed aggregation to at most 64
bands a source is all that touches documents; safeguarded Newton steps then run per source, on all sources in parallel. Rates are
rounded to whole copies by a threshold: a document falls into one of BUCKETS by a hash of its id, size and source, and of a band
the buckets below a cut get one copy more than the others. Cuts are chosen from the tokens of the buckets, from the largest band to
the smallest, each taking over what the one before left. So a document's copies follow from a table of one row a source, and its
text is not shuffled as long as that table can be broadcast.

Targets: sources by code point, null last, get the weights in turn and share all tokens; a target above cap times its source's size
stops there and the excess is shared again by weight, in closed form (water filling). That step sees one narrow row a source in one
task, so the number of sources should stay within some ten millions.

Cases: null text has size 0; a document of size 0 keeps one copy, of 0 words; a null source is a source; repeated rows of equal id,
size and source get equal copies; a very long text is one document like any other, taken whole; an empty table gives an empty
result; columns of the input may have any names. Sums are of whole numbers or in a fixed order, so reruns agree. Only DataFrame
functions run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import WORD, durable

NEWTON_STEPS = 60
BUCKETS = 1024


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def band(size):
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def bucket(id, size, source):
    return F.pmod(F.xxhash64(id, size, source), F.lit(BUCKETS)).cast("int")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Rows (source, source_size, target) from (source, source_size)."""
    everywhere = Window.partitionBy(F.lit(0))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    per = (
        sources.withColumn("i", F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", pick)
        .withColumn("ceiling", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("ceiling") / F.col("weight"))
    )
    order = everywhere.orderBy("ratio", "i")
    level = (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("ceiling").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight"
    ).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    shared = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.struct("ratio", "i"))).over(everywhere)
    return per.select("source", "source_size", F.when(F.col("open"), shared * F.col("weight")).otherwise(F.col("ceiling")).alias("target"))


def tilt(cap: float):
    """The multiplier of a source with bands (band, tokens, parts), mean_band, source_size and target."""
    z = lambda b: b["band"] / F.col("mean_band")

    def step(s, _):
        rate = lambda b: F.least(F.lit(float(cap)), F.exp(s["lam"] * z(b)))
        add = lambda f: F.aggregate("bands", F.lit(0.0), lambda a, b: a + f(b))
        gradient = add(lambda b: b["tokens"] * rate(b)) - F.col("target")
        hessian = add(lambda b: F.when(rate(b) < cap, b["tokens"] * z(b) * rate(b)).otherwise(0.0))
        lo, hi = F.when(gradient < 0, s["lam"]).otherwise(s["lo"]), F.when(gradient > 0, s["lam"]).otherwise(s["hi"])
        newton = s["lam"] - F.try_divide(gradient, hessian)
        inside = newton.isNotNull() & (newton > lo) & (newton < hi)
        return F.struct(F.when(inside, newton).otherwise((lo + hi) / 2).alias("lam"), lo.alias("lo"), hi.alias("hi"))

    start = F.struct(F.lit(0.0).alias("lam"), F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi"))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), start, step)["lam"]
    return F.when(F.col("source_size") == 0, 0.0).when(F.col("target") >= F.col("source_size") * F.lit(float(cap)), 1e6).otherwise(solved)


def cuts(cap: float):
    """For each band, largest first, (band, rate, low, cut): ``low`` copies, and one more for the buckets below ``cut``."""
    top = float(cap)

    def add(s, b):
        rate = F.when(F.col("target") <= 0, 0.0).otherwise(F.least(F.lit(top), F.exp(F.col("lam") * b["band"] / F.col("mean_band"))))
        want, low = rate * b["tokens"] + s["carry"], F.floor(rate).cast("double")
        need = want - low * b["tokens"]

        def nearer(a, p):
            total = a["total"] + p["tokens"]
            off = F.abs(total - need)
            better = off < a["off"]
            return F.struct(
                total.alias("total"), F.when(better, p["bucket"] + 1).otherwise(a["cut"]).alias("cut"), F.least(off, a["off"]).alias("off"), F.when(better, total).otherwise(a["taken"]).alias("taken")
            )

        none = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("cut"), F.abs(need).alias("off"), F.lit(0.0).alias("taken"))
        # At the cap no bucket can get more.
        best = F.when(low >= top, none).otherwise(F.aggregate(b["parts"], none, nearer))
        entry = F.struct(b["band"].alias("band"), rate.alias("rate"), low.cast("long").alias("low"), best["cut"].alias("cut"))
        return F.struct((need - best["taken"]).alias("carry"), F.concat(s["out"], F.array(entry)).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<band:int,rate:double,low:bigint,cut:int>>").alias("out"))
    return F.aggregate(F.reverse(F.filter("bands", lambda b: b["band"] > 0)), start, add)["out"]


def rates(docs: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """One row a source of ``docs`` (source, size, bucket): source, source_size, target, plan (band to rate, low, cut)."""
    counts = durable(docs.groupBy("source", band(F.col("size")).alias("band"), "bucket").agg(F.sum("size").alias("tokens")))
    # BUCKETS numbers a band and 64 bands a source at most.
    parts = F.sort_array(F.collect_list(F.struct("bucket", F.col("tokens").cast("double").alias("tokens"))))
    bands = counts.groupBy("source", "band").agg(F.sum("tokens").alias("total"), parts.alias("parts"))
    per = bands.groupBy("source").agg(
        F.sum("total").alias("source_size"),
        F.try_divide(F.sum(F.col("band") * F.col("total")), F.sum("total")).alias("mean_band"),
        F.sort_array(F.collect_list(F.struct("band", F.col("total").cast("double").alias("tokens"), "parts"))).alias("bands"),
    )
    per = durable(per)
    targets = source_targets(per.select("source", "source_size"), weights, cap).select(F.col("source").alias("s"), "target")
    solved = per.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("lam", tilt(cap))
    entries = F.transform(cuts(cap), lambda e: F.struct(e["band"], F.struct(e["rate"], e["low"], e["cut"])))
    return durable(solved.select("source", "source_size", "target", F.map_from_entries(entries).alias("plan")))


def decided(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``sized`` (..., source, size, bucket) with source_size, target, rate and copies."""
    plan = plan.withColumnRenamed("source", "s")
    mine = F.try_element_at("plan", band(F.col("size")))
    with_plan = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("mine", mine)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("mine")["low"] + (F.col("bucket") < F.col("mine")["cut"]).cast("long"))
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.col("mine")["rate"])
    return with_plan.withColumns({"rate": rate, "copies": copies.cast("long")}).drop("plan", "mine", "bucket")


def mix(df: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Rows (id, source, size, source_size, target, rate, copies), one for each row of ``df``, which is to be taken ``copies`` times."""
    sized = df.select(F.col(id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sized = durable(sized.withColumn("bucket", bucket("id", "size", "source")))
    out = decided(sized, rates(sized, weights, cap))
    return out.select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", "rate", "copies")


def mix_documents(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them."""
    # The row as one value, so that no name of its columns can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sized = rows.withColumn("bucket", bucket("id", "size", "source"))
    out = decided(sized, rates(sized.select("source", "size", "bucket"), weights, cap)).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
