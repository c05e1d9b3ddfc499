"""Approximate nearest neighbours over learned partitions.

On a sample of at most SAMPLE distinct vectors, chosen by a hash of the id, a neighbour graph is built and cut into balanced
parts so that few edges cross. A small classifier (one hidden layer) learns the parts of a vector's neighbours from the vector;
it then assigns every row of the table to its likeliest part and sends each query to its several most probable parts, whose
rows are reranked by exact distances. How many parts that takes is measured on HELD more vectors that the fit has not seen: the
fewest that find TARGET of their neighbours in the sample. There are about sqrt(rows) / 3 parts, SAMPLE / LEAST at most; from
there on parts grow and not their number. A part is cut into blocks of bounded size by the rows that it holds, so one that holds
a third of them is many tasks.

What a query saves depends on the vectors: with clusters it visits few parts; where neighbours lie in all directions, as among
random directions in many dimensions, no partition separates them and the measure asks for nearly all parts.

Cases: see ``vectors``; zero vectors take no part; ties go to smaller ids; an empty table gives no rows; with fewer rows than
asked for, all are found.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors
from ._util import durable

#: Vectors that the fit sees at most, those that the number of visited parts is measured on, and fewest fitted vectors a part.
SAMPLE, HELD, LEAST = 8192, 512, 32
NEIGHBOURS, HIDDEN, EPOCHS = 10, 64, 40
#: Share of the true neighbours of held-out vectors that must be found.
TARGET = 0.95


class Router(NamedTuple):
    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, (x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def likeliest(self, x: np.ndarray, parts: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :parts]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Row i: the k nearest other rows."""
    norms = (x * x).sum(1)
    out = []
    for a in range(0, len(x), 512):
        d = norms[None, :] - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.vstack(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, m: int, rng) -> np.ndarray:
    """Parts of about equal size: capacity-bound k-means to start, then moves that cut fewer edges."""
    n = len(x)
    room = math.ceil(1.1 * n / m)
    centres = x[rng.choice(n, m, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(8):
        d = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
        free = np.full(m, room)
        for i in np.argsort(d.min(1) - d.mean(1), kind="stable"):
            for p in np.argsort(d[i]):
                if free[p]:
                    part[i] = p
                    free[p] -= 1
                    break
        centres = np.stack([x[part == p].mean(0) if (part == p).any() else centres[p] for p in range(m)])
    source, target = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for _ in range(12):
        near = np.zeros((n, m))
        np.add.at(near, (source, part[target]), 1)
        np.add.at(near, (target, part[source]), 1)
        gain = near.max(1) - near[np.arange(n), part]
        size = np.bincount(part, minlength=m)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            p = int(near[i].argmax())
            if size[p] < room:
                size[part[i]] -= 1
                size[p] += 1
                part[i] = p
                moved += 1
        if not moved:
            break
    return part


def learn(x: np.ndarray, m: int, held: np.ndarray, seed: int = 11) -> Router:
    """Parts and classifier of the distinct vectors ``x``; ``held`` are others, which decide how many parts a query visits."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), float(x.std()) or 1.0
    k = min(NEIGHBOURS, len(x) - 1)
    if m <= 1 or k < 1 or not len(held):
        return Router(mean, scale, np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, k)
    part = balanced_parts(x, graph, m, rng)
    goal = np.zeros((len(x), m))
    np.add.at(goal, (np.repeat(np.arange(len(x)), k), part[graph].ravel()), 0.5 / k)
    goal[np.arange(len(x)), part] += 0.5
    z = (x - mean) / scale
    params = [rng.normal(0, math.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, m)), np.zeros(m)]
    first, second = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            i = order[a : a + 128]
            w1, b1, w2, b2 = params
            h = np.maximum(0, z[i] @ w1 + b1)
            s = h @ w2 + b2
            e = np.exp(s - s.max(1, keepdims=True))
            g = (e / e.sum(1, keepdims=True) - goal[i]) / len(i)
            gh = (g @ w2.T) * (h > 0)
            step += 1
            for q, gq, f, v in zip(params, [z[i].T @ gh, gh.sum(0), h.T @ g, g.sum(0)], first, second, strict=True):
                f += 0.1 * (gq - f)
                v += 0.001 * (gq * gq - v)
                q -= 0.003 * (f / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    router = Router(mean, scale, *params, 1)
    # The place at which a held-out vector meets the part of each of its true neighbours.
    home = router.likeliest(x, 1)[:, 0]
    norms = (x * x).sum(1)
    near = np.argpartition(norms[None, :] - 2 * held @ x.T, k - 1, axis=1)[:, :k]
    order = router.likeliest(held, m)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(m)[None, :].repeat(len(held), 0), axis=1)
    met = place[np.arange(len(held))[:, None], home[near]]
    found = np.array([(met < p).mean() for p in range(1, m + 1)])
    return router._replace(probes=int(np.argmax(found >= TARGET)) + 1)


def fit(rows: DataFrame, n: int, seed: int = 11) -> Router | None:
    """The router of ``n`` rows (id, vec); None without any."""
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE + HELD).select("vec").toArrow()
    if not chosen.num_rows:
        return None
    sample = vectors.matrix(chosen.column("vec").combine_chunks())
    sample = np.random.default_rng(seed).permutation(np.unique(sample, axis=0))
    held = min(HELD, len(sample) // 5)
    x = sample[held:]
    return learn(x, min(round(math.sqrt(n) / 3), len(x) // LEAST), sample[:held], seed)


def nearest(df: DataFrame, every: int = 100, k: int = 10, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for the queries whose id is divisible by ``every``."""
    spark = df.sparkSession
    rows = vectors.taking_part(df, id, vec, nonzero=True)
    router = fit(rows, rows.count())
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(router)
    kind = "<f4" if df.schema[vec].dataType == T.ArrayType(T.FloatType(), df.schema[vec].dataType.containsNull) else "<f8"

    def route(probes: int):
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x = vectors.matrix(b.column(1))
                parts = shared.value.likeliest(x, probes)
                at = pa.array(np.repeat(np.arange(len(x)), parts.shape[1]))
                packed = pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(parts.ravel().astype(np.int32)), b.column(0).take(at), packed.take(at)], ["g", "id", "vec"])

        return run

    schema = "g int, id long, vec binary"
    data = durable(rows.mapInArrow(route(1), schema))
    queries = durable(vectors.one_a_query(rows.where(F.col("id") % every == 0)).mapInArrow(route(router.probes), schema))
    counts = lambda t: {r["g"]: r["count"] for r in t.groupBy("g").count().collect()}  # noqa: E731  one row a part
    return vectors.search(queries, data, counts(queries), counts(data), k, "distance", kind)
