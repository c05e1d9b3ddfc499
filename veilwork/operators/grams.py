"""Which of many known secrets may occur in which text, by a distributed join.

A secret is looked for by one run of bytes in it, its anchor: of runs at four places the one that fewest secrets share. Every
place of a text is hashed and asked of one bitmap, which goes to all tasks and never exceeds MOST_BITS; what it lets through is
joined with the anchors on 64 bits of hash. No task or driver ever holds the secrets, only its share of them. What is found
may be too much, and must be looked for in the text itself; it is never too little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import durable

#: Bytes of a run: the most that the secret has. All bytes of UTF-8, where a text holds another only from character to character.
SIZES = (16, 8, 4, 2, 1)
#: Bits of the bitmap: so many a secret, between these bounds (8 kB and 32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28
#: Where the three places of a hash in the bitmap begin in its 64 bits.
_SHIFTS = (0, 18, 36)
#: Rows, and bytes of text, that are worked on at once.
ROWS, BYTES = 512, 1 << 18


def slices(batches) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of few rows, which are made Python objects one piece at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _mixed(h: np.ndarray, size: int) -> np.ndarray:
    h = h + np.uint64(size * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(data: np.ndarray, sizes) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``sizes`` the hashes of all runs of so many bytes along the last axis."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while data.shape[-1] >= size:
        if size in sizes:
            yield size, _mixed(h, size)
        if size >= max(sizes):
            return
        # Twice the size from two neighbours; the factor is another one at each step.
        h = h[..., :-size] * np.uint64(0xD6E8FEB86659FD93 + 2 * size) + (h[..., size:] ^ (h[..., size:] >> np.uint64(29)))
        size *= 2


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins and the last one ends."""
    texts = texts.cast(pa.large_binary())
    _, at, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8), np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]


def runs(secrets: pa.Array) -> pa.RecordBatch:
    """Rows (row, size, place, anchor): up to four runs of each secret."""
    data, at = _bytes(secrets)
    n = at[1:] - at[:-1]
    out = []
    for size in SIZES:
        rows = np.flatnonzero((n >= size) & (n < 2 * size if size < SIZES[0] else True))
        free, last = n[rows] - size, None
        for k in range(4 if len(rows) else 0):
            place = free * k // 3
            new = np.ones(len(rows), bool) if last is None else place > last
            where = at[rows][new] + place[new]
            for _, h in _hashes(data[where[:, None] + np.arange(size)], (size,)):
                out.append((rows[new], np.full(len(where), size), place[new], h[:, 0].view(np.int64)))
            last = place
    columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "size", "place", "anchor"])


def anchored(secrets: DataFrame) -> DataFrame:
    """Rows (secret, size, anchor), one for each of the different ``secrets`` (secret), none of which is empty."""

    def run(batches):
        for b in slices(batches):
            found = runs(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(found.column(0)), *found.columns[1:]], ["secret", "size", "place", "anchor"])

    rows = secrets.select("secret").mapInArrow(run, "secret string, size long, place long, anchor long")
    shared = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(F.struct("size", "anchor"), F.struct("n", -F.col("place")))
    return durable(rows.join(shared, "anchor").groupBy("secret").agg(best.alias("a")).select("secret", "a.size", "a.anchor"))


def _place(anchor: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(anchor, shift).bitwiseAND(F.lit(bits - 1))


def bitmap(anchors: DataFrame, n: int) -> np.ndarray:
    """The bitmap of ``n`` anchors, as bytes."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n - 1).bit_length()))
    # Spark's places begin at 1.
    x = F.explode(F.array(*[_place(F.col("anchor"), s, bits) + 1 for s in _SHIFTS]))
    parts = anchors.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():
        out[(r["i"] - 1) * 4096 : r["i"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def met(texts: pa.Array, sizes: set[int], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), in order and once each, of the runs in ``texts`` that the bitmap lets through."""
    data, at = _bytes(texts)
    mask = np.uint64(len(table) * 8 - 1)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start in range(at[0], at[-1], BYTES):
        piece = data[start : min(start + BYTES + max(sizes) - 1, at[-1])]
        for size, h in _hashes(piece, sizes):
            place = np.arange(min(len(h), BYTES))
            h = h[: len(place)]
            for shift in _SHIFTS:
                bit = (h >> np.uint64(shift)) & mask
                held = np.flatnonzero(table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                place, h = place[held], h[held]
            row = np.searchsorted(at, place + start, "right") - 1
            inside = place + start + size <= at[row + 1]
            rows.append(row[inside])
            found.append(h[inside])
    pairs = np.unique(np.rec.fromarrays([np.concatenate(rows), np.concatenate(found)]))
    return pairs["f0"], pairs["f1"].view(np.int64)


def with_secrets(rows: DataFrame, secrets: DataFrame, more=None, all_rows: bool = True) -> DataFrame:
    """``rows`` (row, t) with ``found``: those of the different ``secrets`` that may occur in the text ``t``.

    ``more`` gives further strings in which secrets of a text may occur; they are asked of where the text itself may hold one.
    Without ``all_rows`` those where nothing is found may be left out. The rows are computed once, and only those that may hold
    something are moved.
    """
    spark = rows.sparkSession
    held = anchored(secrets)
    facts = held.agg(F.count(F.lit(1)).alias("n"), F.collect_set("size").alias("sizes")).first()
    shared, sizes = spark.sparkContext.broadcast(bitmap(held, facts["n"])), set(facts["sizes"])

    def run(batches):
        for b in slices(batches):
            row, h = met(b.column(1), sizes, shared.value)
            if more is not None and len(row):
                texts = b.column(1)
                beside = [(i, s.encode("utf-8", "surrogatepass")) for i in np.unique(row).tolist() for s in more(texts[i].as_py())]
                if beside:
                    at, new = met(pa.array([s for _, s in beside], pa.large_binary()), sizes, shared.value)
                    pairs = np.unique(np.rec.fromarrays([np.concatenate([row, np.array([i for i, _ in beside], np.int64)[at]]), np.concatenate([h, new])]))
                    row, h = pairs["f0"], pairs["f1"]
            ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(h, pa.int64()))], ["row", "t", "anchors"])

    kind = rows.select("row", "t", F.array().cast("array<bigint>").alias("anchors")).schema
    marked = durable(rows.select("row", "t").mapInArrow(run, kind).withColumn("id", F.monotonically_increasing_id()))
    some = F.size("anchors") > 0
    pairs = marked.where(some).select("id", F.explode("anchors").alias("anchor")).join(held.select("secret", "anchor"), "anchor")
    found = pairs.groupBy("id").agg(F.collect_list("secret").alias("found"))
    out = marked.where(some).join(found, "id", "left" if all_rows else "inner").select("row", "t", "found")
    return out.unionByName(marked.where(~some).select("row", "t", F.lit(None).cast("array<string>").alias("found"))) if all_rows else out
