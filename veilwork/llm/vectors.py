"""What both vector searches share: which rows take part, how rows and queries meet, and exact top-k inside blocks.

A row takes part if its id is not null and its vector has the most frequent length, no null and only finite components. Every
such row is a candidate, repeated ones each; a query is one id (of rows that share it, the one with the smallest vector), and
rows with the query's id are its own and no candidates. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidate rows of a block, query rows that meet it in one task, and query rows that are solved against it at once.
BLOCK, PART, CHUNK = 8192, 16_384, 256
#: Pairs whose differences are taken at once.
PAIRS = 65_536


def taking_part(df: DataFrame, id: str, vec: str, nonzero: bool) -> DataFrame:
    """Rows (id long, vec array<double>)."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0")
    rows = rows.where(F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x)))
    if nonzero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vec") == (common["d"] if common else 0))


def one_a_query(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(column) -> np.ndarray:
    """An Arrow list column without nulls as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of integer vectors, exact: in doubles where no sum can leave 53 bits, else in 64-bit integers."""
    if len(x) and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2.0**53:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return (q @ x.T).astype(np.int64)


def _first(row: np.ndarray, rank: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest ranks of each row, ties to smaller ids; rows and their ranks in order."""
    order = np.lexsort((ids, rank, row))
    row = row[order]
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, int)
    place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    return order[place < k]


def _near(cost: np.ndarray, k: int, margin) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries that do not exceed the k-th smallest of their row by more than the margin."""
    if cost.shape[1] <= k:
        return np.nonzero(np.ones(cost.shape, bool))
    top = np.partition(cost, k - 1, axis=1)[:, k - 1]
    return np.nonzero(cost <= (top + margin)[:, None])


def solve(queries: pd.DataFrame, data: pd.DataFrame, k: int, measure: str, kind: str) -> Iterator[pd.DataFrame]:
    q, x = (np.frombuffer(b"".join(t["vec"]), kind).reshape(len(t), -1).astype(np.float64) for t in (queries, data))
    qid, xid = queries["id"].to_numpy(), data["id"].to_numpy()
    norms = (x * x).sum(1)
    for a in range(0, len(q), CHUNK):
        part, own = q[a : a + CHUNK], qid[a : a + CHUNK, None] == xid[None, :]
        if measure == "product":
            cost = -inner_products(part, x)
            cost[own] = np.iinfo(np.int64).max
            row, column = _near(cost, k, 0)
            rank = cost[row, column]
        else:
            # Products preselect with a margin for rounding, differences decide.
            cost = norms[None, :] - 2 * (part @ x.T)
            cost[own] = np.inf
            row, column = _near(cost, k, 1e-9 * (norms.max() + (part * part).sum(1) + 1))
            pieces = [((x[column[i : i + PAIRS]] - part[row[i : i + PAIRS]]) ** 2).sum(1) for i in range(0, len(row), PAIRS)]
            rank = np.sqrt(np.concatenate(pieces)) if pieces else np.zeros(0)
        mine = ~own[row, column]
        row, column, rank = row[mine], column[mine], rank[mine]
        best = _first(row, rank, xid[column], k)
        yield pd.DataFrame({"query_id": qid[a + row[best]], "vec_id": xid[column[best]], "score": -rank[best] if measure == "product" else rank[best]})


def _count(counts: dict[int, int], size: int) -> Column:
    """How many shares of ``size`` the rows of group ``g`` make; 0 for groups without rows."""
    shares = {g: math.ceil(n / size) for g, n in counts.items() if n}
    if not shares:
        return F.lit(0)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in shares.items() for v in pair]), F.col("g")), F.lit(0))


def search(queries: DataFrame, data: DataFrame, asked: dict[int, int], sent: dict[int, int], k: int, measure: str, kind: str) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) from rows (g int, id, vec binary) of both sides that meet where ``g`` is equal.

    ``asked`` and ``sent`` are the counts of both sides by group: they cut a group's rows into blocks and its queries into parts,
    so that a task has at most about BLOCK of the ones and PART of the others, whatever the group's size. ``kind`` is the
    numpy type of the components.
    """
    blocks, parts = _count(sent, BLOCK), _count(asked, PART)
    # A row's place deals rows evenly, equal ones too.
    dealt = data.withColumn("b", F.pmod(F.monotonically_increasing_id(), F.greatest(blocks, F.lit(1))).cast("int"))
    dealt = dealt.withColumn("_parts", parts).where("_parts > 0").select("g", "b", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), "id", "vec")
    spread = queries.withColumns({"_blocks": blocks, "part": F.pmod(F.xxhash64("id"), F.greatest(parts, F.lit(1))).cast("int")})
    spread = spread.where("_blocks > 0").select("g", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("b"), "part", "id", "vec")
    number = "long" if measure == "product" else "double"
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64" if measure == "product" else "float64")})

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(solve(left, right, k, measure, kind)) if len(left) and len(right) else []
        return pd.concat(found) if found else empty

    keys = ["g", "b", "part"]
    near = spread.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(run, f"query_id long, vec_id long, score {number}")
    order = [F.desc("score") if measure == "product" else F.asc("score"), F.asc("vec_id")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
