"""Exact top-k inner products by a Voronoi kNN join.

With one more coordinate, sqrt(M**2 - |x|**2) for data (M the largest norm) and 0 for queries, the largest inner products are
the smallest Euclidean distances. Pivots split that space into cells. A first pass writes every row's cell and distances to
the pivots. Summaries of a few numbers a cell then give, for each group of query cells, a radius that surely holds k neighbours
and the range of its queries' distances to every pivot. Cells start as groups of their own; two are merged where that saves
copies of data rows and does not add to the pairs compared, so bounds that prune little make few groups and few copies. A data
row goes to the groups whose radius its distance bounds do not exceed, and to no others. How many rows each group gets is counted
before they are sent, and that count cuts it into blocks, which are solved on their own and merged. All of it is exact: the
bounds only leave out rows that cannot be among the k nearest, ties included.

What grows: the pairs compared are queries times candidates less what the bounds prune, which on vectors without clusters is
little; rows sent are one a candidate and group for each ``vectors.PART`` queries, and one a query for each ``vectors.BLOCK``
candidates.

Cases: see ``vectors``; ties go to smaller ids; rows of the query's own id, however many, count for no bound; an empty table
gives no rows; with fewer candidates than asked for, all are found.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors
from ._util import durable

#: Rows the pivots are chosen from; which are chosen changes the work and not the result.
PIVOT_POOL = 2048
SLACK = 1e-6
#: A merged group may compare this much more than its parts.
WASTE = 1.1


def integers(rows: DataFrame, scale: float = 64.0) -> DataFrame:
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * F.lit(scale)).cast("double")))


def choose_pivots(pool: np.ndarray, m: int) -> np.ndarray:
    """Farthest-first, from the vector nearest the mean."""
    pool = np.unique(pool, axis=0)
    at = [int(((pool - pool.mean(0)) ** 2).sum(1).argmin())]
    far = ((pool - pool[at[0]]) ** 2).sum(1)
    while len(at) < min(m, len(pool)):
        at.append(int(far.argmax()))
        far = np.minimum(far, ((pool - pool[at[-1]]) ** 2).sum(1))
    return pool[at]


def with_distances(rows: DataFrame, pivots: np.ndarray, last: float | None, kind: str, spark: SparkSession) -> DataFrame:
    """Rows (id, vec binary, cell, dist array<double>); last: M**2 for data, None for queries."""
    shared = spark.sparkContext.broadcast(pivots)

    def run(batches):
        p = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors.matrix(b.column(1))
            extra = np.zeros(len(x)) if last is None else np.sqrt(np.maximum(0.0, last - (x * x).sum(1)))
            full = np.hstack([x, extra[:, None]])
            d = np.sqrt(np.stack([((full - row) ** 2).sum(1) for row in p], axis=1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array(d.argmin(1).astype(np.int32)), pa.array(list(d), pa.list_(pa.float64()))],
                ["id", "vec", "cell", "dist"],
            )

    return rows.select("id", "vec").mapInArrow(run, "id long, vec binary, cell int, dist array<double>")


class Cell(NamedTuple):
    """What is known of a cell's rows: their number and the range of their distances to each pivot."""

    n: int
    lo: np.ndarray
    hi: np.ndarray


def cells(rows: DataFrame, m: int) -> dict[int, Cell]:
    """By cell; m rows of 2 m numbers at most."""
    lo, hi = (F.array(*[f(F.col("dist")[j]) for j in range(m)]) for f in (F.min, F.max))
    got = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), lo.alias("lo"), hi.alias("hi"))
    return {r["cell"]: Cell(r["n"], np.array(r["lo"]), np.array(r["hi"])) for r in got.collect()}


def nearest_ids(data: DataFrame, need: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By cell, (distances, ids) of the ``need`` different ids nearest its pivot: kept by each task, then merged."""

    def run(batches):
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            cell, d, ids = (c.to_numpy() for c in b.columns)
            for c in np.unique(cell).tolist():
                old = kept.get(c, (d[:0], ids[:0]))
                ds, xs = np.concatenate([old[0], d[cell == c]]), np.concatenate([old[1], ids[cell == c]])
                order = np.argsort(ds, kind="stable")
                first = np.sort(np.unique(xs[order], return_index=True)[1])[:need]
                kept[c] = ds[order][first], xs[order][first]
        out = [(np.full(len(d), c, np.int32), d, x) for c, (d, x) in kept.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["cell", "d", "id"])

    rows = data.select("cell", F.col("dist")[F.col("cell")].alias("d"), "id").mapInArrow(run, "cell int, d double, id long")
    rows = rows.groupBy("cell", "id").agg(F.min("d").alias("d"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("d", "id"))).where(F.col("r") <= need)
    out: dict[int, tuple[list, list]] = {}
    for r in rows.orderBy("cell", "d", "id").collect():  # cells times need
        d, ids = out.setdefault(r["cell"], ([], []))
        d.append(r["d"])
        ids.append(r["id"])
    return {c: (np.array(d), np.array(ids)) for c, (d, ids) in out.items()}


class Group(NamedTuple):
    cells: tuple[int, ...]
    n: int
    lo: np.ndarray
    hi: np.ndarray
    radius: float
    sent: int  # data rows at most, by whole cells

    def copies(self) -> int:
        return self.sent * math.ceil(self.n / vectors.PART)


def group(members: tuple[int, ...], asked: dict[int, Cell], data: dict[int, Cell], near: dict, need: int) -> Group:
    n, lo, hi = sum(asked[c].n for c in members), np.min([asked[c].lo for c in members], axis=0), np.max([asked[c].hi for c in members], axis=0)
    # A row at distance d of pivot c is at most hi[c] + d away from every query of the group.
    bounds = np.concatenate([hi[c] + d for c, (d, _) in near.items()])
    ids = np.concatenate([x for _, x in near.values()])
    order = np.argsort(bounds, kind="stable")
    first = np.sort(np.unique(ids[order], return_index=True)[1])
    radius = float(bounds[order][first[need - 1]]) * (1 + SLACK) + SLACK if len(first) >= need else math.inf
    sent = sum(d.n for d in data.values() if np.maximum(d.lo - hi, lo - d.hi).max() <= radius)
    return Group(members, n, lo, hi, radius, sent)


def groups(asked: dict[int, Cell], data: dict[int, Cell], near: dict, need: int) -> list[Group]:
    """Query cells merged where that saves copies and adds no pairs to speak of."""
    out = [group((c,), asked, data, near, need) for c in sorted(asked)]
    both: dict[tuple, Group] = {}
    while True:
        best = None
        for i, a in enumerate(out):
            for b in out[:i]:
                key = (a.cells, b.cells)
                if key not in both:
                    both[key] = group(b.cells + a.cells, asked, data, near, need)
                c = both[key]
                saved = a.copies() + b.copies() - c.copies()
                if saved > 0 and c.n * c.sent <= WASTE * (a.n * a.sent + b.n * b.sent) and (best is None or saved > best[0]):
                    best = saved, a, b, c
        if best is None:
            return out
        _, a, b, c = best
        out = [g for g in out if g is not a and g is not b] + [c]


def top_products(df: DataFrame, every: int = 20, k: int = 20, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the queries whose id is divisible by ``every``."""
    spark = df.sparkSession
    rows = integers(vectors.taking_part(df, id, vec, nonzero=False))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m"), F.max(F.array_max(F.transform("vec", F.abs))).alias("a")).first()
    n, top, largest = facts["n"], float(facts["m"] or 0.0), float(facts["a"] or 0.0)
    kind = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<f8"
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_POOL).select("vec").toArrow()
    if not chosen.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pool = vectors.matrix(chosen.column("vec").combine_chunks())
    pool = np.hstack([pool, np.sqrt(np.maximum(0.0, top - (pool * pool).sum(1)))[:, None]])
    pivots = choose_pivots(pool, int(min(64, max(4, math.sqrt(n) / 16))))
    m = len(pivots)

    data = durable(with_distances(rows, pivots, top, kind, spark))
    queries = durable(with_distances(vectors.one_a_query(rows.where(F.col("id") % every == 0)), pivots, None, kind, spark))
    # k rows of other ids than a query's own are among k + 1 ids.
    chosen = groups(cells(queries, m), cells(data, m), nearest_ids(data, k + 1), k + 1)
    plan = spark.sparkContext.broadcast([(g.lo, g.hi, g.radius) for g in chosen])

    def wanted(d: np.ndarray):
        for g, (lo, hi, radius) in enumerate(plan.value):
            yield g, np.flatnonzero(np.maximum(d - hi[None, :], lo[None, :] - d).max(1) <= radius)

    def count(batches):
        sums = np.zeros(len(plan.value), np.int64)
        for b in batches:
            if b.num_rows:
                for g, at in wanted(vectors.matrix(b.column(0))):
                    sums[g] += len(at)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], ["g", "n"])

    def replicate(batches):
        for b in batches:
            if b.num_rows:
                for g, at in wanted(vectors.matrix(b.column(2))):
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), b.column(0).take(take), b.column(1).take(take)], ["g", "id", "vec"])

    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sent = {r["g"]: r["n"] for r in data.select("dist").mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}  # m rows at most
    of = {c: i for i, g in enumerate(chosen) for c in g.cells}
    asked = queries.select(F.element_at(F.create_map(*[F.lit(v) for pair in of.items() for v in pair]), F.col("cell")).alias("g"), "id", "vec")
    copies = data.select("id", "vec", "dist").mapInArrow(replicate, "g int, id long, vec binary")
    return vectors.search(asked, copies, {i: g.n for i, g in enumerate(chosen)}, sent, k, "product", kind)
