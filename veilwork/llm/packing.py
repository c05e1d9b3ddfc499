"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

One pass tokenizes whole documents on the map side and keeps lengths and checksums of their pieces. The histogram of piece
lengths, at most ``capacity`` rows, goes to the driver, where the configuration program of ``packing_lp`` is solved and rounded to
configurations and multiplicities. Pieces of a length are then numbered and read their sequence and offset off a table of runs
whose size is bounded by the rounds of that program. Numbering counts inside hashed slices of a length, of about SLICE_ROWS pieces
at most, and adds the slices' prefix sums, so a length that a third of all pieces have is spread like any other.

Cases: a null or empty text is the single id 0; repeated rows are packed each, and which of equal pieces comes first does not
matter; an empty table gives no rows; a null id stays null. A very long text is tokenized whole and its ids cut at multiples of the
capacity; shorter ones are never cut. Of the input only id and text are read, whatever the names of other columns.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import packing_lp
from ._util import durable, slices, small_batches
from .tokens import WordIds, default_path, worker

#: Least number of slices of a length, and pieces of the table for which there is one more.
SLICES, SLICE_ROWS = 64, 500_000
#: Words that a worker remembers.
CACHE = 700_000


def pieces(df: DataFrame, id: str, text: str, capacity: int, path: str, cache: int) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32)."""
    kind = df.schema[id].dataType

    def make(batches):
        encode = worker(WordIds, path, cache)
        encode.words.most = cache
        width = 4 * capacity
        for b in slices(batches, cached=True):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode([t or "" for t in b.column(1).to_pylist()])):
                ids += b"\0\0\0\0"
                for k, x in enumerate(range(0, len(ids), width)):
                    part = ids[x : x + width]
                    at.append(i)
                    piece.append(k)
                    start.append(x // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    schema = f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return small_batches(df).select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(make, schema)


def runs(packed: list[tuple[packing_lp.Configuration, int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, copies a sequence, first offset)."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for configuration, times in packed:
        offset = 0
        for length, copies in configuration:
            first = ranks.get(length, 0)
            out.setdefault(length, []).append((first, sequence, copies, offset))
            ranks[length] = first + times * copies
            offset += length * copies
        sequence += times
    return {n: np.array(x, np.int64) for n, x in out.items()}


def pack(df: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = 2048, path: str | None = None, cache: int = CACHE) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset), one a piece. ``cache``: words that a worker remembers, about 200 bytes each."""
    spark = df.sparkSession
    cut = durable(pieces(df, id, text, capacity, path or default_path("word_bpe_49k.json"), cache))
    slices_of_a_length = max(SLICES, cut.count() // SLICE_ROWS)
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(slices_of_a_length)).cast("int"))
    counts = cut.groupBy("length", "slice").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    table = spark.sparkContext.broadcast(runs(packing_lp.solve(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "slice").orderBy("id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(inside).cast("long") - 1).join(offsets, ["length", "slice"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n = int(length[part[0]])
                t = table.value[n]
                row = t[np.searchsorted(t[:, 0], rank[part], side="right") - 1]
                k = rank[part] - row[:, 0]
                sequence[part] = row[:, 1] + k // row[:, 2]
                offset[part] = row[:, 3] + k % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = df.schema[id].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema).withColumnRenamed("id", id)
