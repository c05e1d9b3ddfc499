"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: words and word stems (prefixes of three lengths), hashed to 2**HASH_BITS places. The
machine scores

    sigmoid(w0 + sum_i w_i + sum_{i<j} <v_i, v_j>),

so a pair of terms, an insult with a group mention for instance, weighs other than the sum of its parts. It is fitted on the
driver on at most ``max_rows`` distinct labelled texts a class, chosen by a hash of the id and weighted back to the distinct
texts of the class, over all places whose class frequencies differ with a z value over LEAST_Z in either direction. Scoring is
a map over whole texts with a broadcast model of those places, which are 2**HASH_BITS at most.

Cases: null and empty texts get the score of no terms; repeated rows are scored each; copies of a text count once in a class;
a document labelled twice is toxic if one label says so; of unlike texts with one id the one with the largest hash is learnt from; a
null id is not held out; very long texts are scored whole; an empty table gives no rows; without labels of both classes every score is
the share of toxic rows (0 if there is none). Inputs of a score are the words of the text alone.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import durable, slices, small_batches, sole

HASH_BITS = 20
STEMS = (4, 5, 6)
LEAST_Z = 3.5
#: Bound on the distinct labelled texts of each class that the fit reads.
MAX_ROWS = 4000
FACTORS, EPOCHS, RATE, DECAY = 4, 30, 0.05, 1e-5
_WORD = re.compile(r"[^\W\d_]+")
CACHE = 250_000


def places(token: str) -> frozenset[int]:
    """Hash places of the terms of a white-space token."""
    out = set()
    for w in _WORD.findall(token.lower()):
        out.add(w)
        out.update(f"{w[:n]}*" for n in STEMS if len(w) >= n)
    return frozenset(zlib.crc32(t.encode("utf-8", "surrogatepass")) >> (32 - HASH_BITS) for t in out)


class Model(NamedTuple):
    row: dict[int, int]  # hash place -> row of the weights
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, rows: list[int]) -> float:
        z = self.w0
        if rows:
            v = self.v[rows]
            s = v.sum(0)
            z += self.w[rows].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-min(35.0, max(-35.0, z)))))


def fit(chosen: list[int], docs: Sequence[Sequence[int]], labels: list[int], weights: list[float], seed: int = 7) -> Model:
    """Weights of the ``chosen`` hash places from documents as lists of those that they hold."""
    y, cost = np.array(labels, float), np.array(weights, float)
    share = float((y * cost).sum() / cost.sum()) if len(y) else 0.0
    w0 = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not len(y) or y.min() == y.max():
        return Model({}, w0, np.zeros(0), np.zeros((0, FACTORS)))
    row = {t: i for i, t in enumerate(sorted(chosen))}
    held = np.array(sorted(chosen), np.int64)
    rows = [np.searchsorted(held, np.asarray(terms, np.int64)) for terms in docs]
    place = np.zeros(len(row), np.int64)
    rng = np.random.default_rng(seed)
    # Adam over mini-batches.
    w, v, b = np.zeros(len(row), np.float32), rng.normal(0, 0.01, (len(row), FACTORS)).astype(np.float32), np.array([w0], np.float32)
    y, cost = y.astype(np.float32), cost.astype(np.float32)
    params = [b, w, v]
    m, s = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    cost = cost / cost.mean()
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 128):
            k = order[a : a + 128]
            # Only the places that the batch holds get columns.
            at = np.concatenate([rows[i] for i in k])
            here = np.zeros(len(row), bool)
            here[at] = True
            u = np.flatnonzero(here)
            place[u] = np.arange(len(u))
            xb = np.zeros((len(k), len(u)), np.float32)
            xb[np.repeat(np.arange(len(k)), [len(rows[i]) for i in k]), place[at]] = 1
            wu, vu = w[u], v[u]
            xv = xb @ vu
            score = b[0] + xb @ wu + 0.5 * ((xv * xv).sum(1) - xb @ (vu * vu).sum(1))
            g = cost[k] * (1 / (1 + np.exp(-np.clip(score, -35, 35))) - y[k]) / len(k)
            gw, gv, xg = DECAY * w, 10 * DECAY * v, xb.T @ g
            gw[u] += xg
            gv[u] += xb.T @ (g[:, None] * xv) - xg[:, None] * vu
            grads = [np.array([g.sum()]), gw, gv]
            step += 1
            for q, gq, mq, sq in zip(params, grads, m, s, strict=True):
                mq += 0.1 * (gq - mq)
                sq += 0.001 * (gq * gq - sq)
                q -= RATE * (mq / (1 - 0.9**step)) / (np.sqrt(sq / (1 - 0.999**step)) + 1e-8)
    return Model(row, float(b[0]), w, v)


def held_out(id):
    return F.coalesce(F.crc32(id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled documents that are not held out."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id)))
    known = known.groupBy(F.col(id).alias("_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    # Copies of a text count once in a class, for the smallest id.
    texts = small_batches(docs).select(F.col(id).alias("_id"), F.col(text).alias("t")).withColumn("h", F.xxhash64(F.coalesce("t", F.lit(""))))
    texts_of = texts.select("_id", "h").join(known, "_id").groupBy("_id", "y").agg(F.max("h").alias("h"))
    known = durable(texts_of.groupBy("y", "h").agg(F.min("_id").alias("_id")))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in totals:
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return fit([], [], [], [])

    def terms(batches):
        for b in slices(batches):
            sets = [sorted(set().union(*map(places, set((t or "").split())))) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int32()))], ["id", "y", "terms"])

    # 2 * max_rows ids at most: a bounded side.
    rows = texts.join(F.broadcast(picked), ["_id", "h"]).groupBy("_id", "y").agg(F.max("t").alias("t"))
    kind = docs.schema[id].dataType.simpleString()
    rows = durable(rows.select("_id", "y", "t").mapInArrow(terms, f"id {kind}, y int, terms array<int>"))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        return fit([], [], list(n), [1.0] * len(n))
    # Places by the z value of the difference between their class frequencies.
    seen = rows.select("y", F.explode("terms").alias("t")).groupBy("t").agg(F.sum("y").alias("c1"), F.count(F.lit(1)).alias("c"))
    p1, p0, p = F.col("c1") / n[1], (F.col("c") - F.col("c1")) / n[0], F.col("c") / (n[0] + n[1])
    z = F.abs(p1 - p0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n[0] + 1 / n[1]))
    chosen = seen.where("c >= 4").where(z > LEAST_Z).select("t").orderBy("t").toArrow().column("t").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def held(batches):
        for b in batches:
            sets = [np.intersect1d(s.values.to_numpy(), shared.value, assume_unique=True) for s in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.list_(pa.int32()))], ["id", "y", "terms"])

    got = rows.mapInArrow(held, rows.schema).orderBy("id").toArrow()  # 2 * max_rows rows at most
    labels = got.column("y").to_pylist()
    return fit(chosen.tolist(), [s.values.to_numpy() for s in got.column("terms")], labels, [totals[y] / n[y] for y in labels])


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def rows(self, token: str) -> tuple[int, ...]:
        row = self.model.row
        return tuple(row[p] for p in places(token) if p in row)

    def __call__(self, text: str | None) -> float:
        if not text:
            return self.model.score([])
        tokens = set(text.split())
        if len(self.known) > CACHE:
            self.known.clear()
        for t in tokens.difference(self.known):
            self.known[t] = self.rows(t)
        # Most tokens have no place in the model and share one empty entry.
        held = set(filter(None, map(self.known.__getitem__, tokens)))
        return self.model.score(sorted(set().union(*held)))


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All rows and columns of ``docs`` with the score and whether it reaches the threshold; columns of those names are replaced."""
    columns = [c for c in docs.columns if c not in names]
    docs = small_batches(docs).select(*columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, token = columns.index(text), uuid.uuid4().int

    def run(batches):
        scorer = sole(token, lambda: Scorer(shared.value))
        for b in slices(batches, cached=True):
            s = np.array([scorer(t) for t in b.column(at).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*columns, *names])

    schema = T.StructType([*docs.schema, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return docs.mapInArrow(run, schema)
