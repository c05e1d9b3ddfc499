"""SimHash near-duplicates by pivot distance tables.

A fingerprint is compared through its Hamming distances to REFERENCES fixed reference fingerprints, its row of the pivot
table: by the triangle inequality two fingerprints within ``radius`` differ by at most ``radius`` in each coordinate, so the
maximum coordinate difference discards pairs and only the survivors are verified bit by bit. Of two million pairs of one group, which
differ in up to 32 bits, the table left 122, of which 120 were near; of as many that differ in up to 16 bits 6,261, of which 4,221 were
near (``Pairs`` counts them).

Which pairs the table sees: a coordinate alone keeps few fingerprints apart (two random ones are within 2 of each other in every
third coordinate), so a join on coordinates would send each of them to hundreds of cells before its groups stopped growing with the
table. Keys come first for that reason: of four blocks of 16 bits two that differ in at most two bits agree in at least two, so they
meet under one of six choices. Exact copies are one fingerprint before that. The table is asked for all pairs of a group of up to
LARGE members; larger groups, which are near copies of one text or the tail of a huge table, are cut again by two of the four bytes
that their members do not share, so what a task compares is bounded by 65,536 fingerprints that differ in 16 bits at most. Groups
are read in a stream of sorted rows and give the links of a spanning forest, never their pairs. Components then grow by star
contraction in O(log n) rounds of joins.

Cases: null text is empty; documents without words have fingerprint 0, which links like any other; repeated rows are kept, ties go
to the smallest id; a null id has a component but is never its smallest unless all are null; very long texts are read in blocks of
words; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_copies
from ._util import durable, slices, small_batches
from .groups import keep_first, with_components
from .pivots import REFERENCES, Pairs, byte_counts, majority
from .shingles import blocks

RADIUS = 2
#: Members of a group whose pairs are compared as they are.
LARGE = 4096


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a whole text as an unsigned number."""
    counts, n, tail = np.zeros((8, 256), np.int64), 0, []
    hashed = xxhash.xxh64_intdigest
    for block in blocks(text.encode("utf-8", "surrogatepass").lower()):  # bytes.lower() is A-Z only, as is bytes.split() white space
        words = tail + block.split()
        k = len(words) - shingle + 1
        if k > 0:
            parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
            h = np.fromiter((hashed(p, 42) for p in parts), np.uint64, k)
            counts += byte_counts(h)
            n += k
            tail = words[k:]
        else:
            tail = words
    if n == 0:
        return hashed(b" ".join(tail), 42) if tail else 0
    return majority(counts, n)


def fingerprints(texts: DataFrame, shingle: int = 3) -> DataFrame:
    """Rows (id, h, fp) of ``texts`` (id, h, t): fp is the fingerprint as a signed long."""

    def make(batches):
        for b in slices(batches):
            fps = [fingerprint(t, shingle) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "h", "fp"])

    return texts.mapInArrow(make, f"id {texts.schema['id'].dataType.simpleString()}, h long, fp long")


def pivot_links(fps: np.ndarray, radius: int = RADIUS, pairs: Pairs | None = None) -> list[tuple[int, int]]:
    """Spanning links of the fingerprints (unsigned, distinct) within ``radius`` of each other."""
    n, pairs = len(fps), pairs or Pairs()
    pairs.met += n * (n - 1) // 2
    distances = np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    order = np.argsort(distances[:, 0], kind="stable")
    fps, distances = fps[order], distances[order]
    first = distances[:, 0]
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    step = max(1, min(n, 4_000_000 // max(n, 1)))
    for a in range(0, n, step):
        b = min(n, a + step)
        # Sorted by the first coordinate: later rows beyond the radius need no look.
        end = int(np.searchsorted(first, first[b - 1] + radius, side="right"))
        x, y = np.nonzero(np.abs(first[a:b, None] - first[None, a:end]) <= radius)
        keep = y > x
        x, y = x[keep] + a, y[keep] + a
        for k in range(1, distances.shape[1]):
            if not len(x):
                break
            keep = np.abs(distances[x, k] - distances[y, k]) <= radius
            x, y = x[keep], y[keep]
        keep = np.bitwise_count(fps[x] ^ fps[y]) <= radius
        pairs.left += len(x)
        pairs.near += int(keep.sum())
        for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True):
            p, q = find(i), find(j)
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((int(fps[i]), int(fps[j])))
    return links


def _field(fp: Column, parts, width: int) -> Column:
    """The given parts of a fingerprint, each ``width`` bits wide, side by side as one number."""
    out = F.lit(0).cast("long")
    for i in parts:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return out


#: Choices of two of four blocks of 16 bits, and for each the bytes of the other two.
_BLOCKS = list(combinations(range(4), 2))
_REST = [[b for i in range(4) if i not in c for b in (2 * i, 2 * i + 1)] for c in _BLOCKS]


def _link_rows(found: list[tuple[int, int]], **more) -> pa.RecordBatch:
    sides = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(sides[:, 0]), pa.array(sides[:, 1]), *(pa.nulls(len(sides), t) for t in more.values())], ["a", "b", *more])


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (a, b), a spanning set of the links between distinct fingerprints ``fp``."""
    if not 0 <= radius <= 2:
        raise ValueError("two equal blocks of four are certain for at most two bits")
    fp = F.col("fp")
    # The choice in front of the 32 bits that it takes.
    keys = F.array(*[F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(_field(fp, c, 16)) for i, c in enumerate(_BLOCKS)])
    # Few bytes a fingerprint, but six keys each: dealt to all tasks before they are made.
    dealt = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")

    def meet(batches):
        """Links of the groups of sorted rows (k, fp), and members (a, k) of the large ones."""
        k, fps, open_key = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def out(k, fps, last):
            nonlocal open_key
            if not len(k):
                return
            start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            count = np.diff(np.append(start, len(k)))
            large = (count > LARGE) | (k[start] == open_key)
            if not last:
                large[-1], open_key = True, int(k[-1])
            if large.any():
                at = np.repeat(large, count)
                yield pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.nulls(int(at.sum()), pa.int64()), pa.array(k[at])], ["a", "b", "k"])
            found = []
            for s, n in zip(start[~large & (count > 1)].tolist(), count[~large & (count > 1)].tolist(), strict=True):
                found += pivot_links(fps[s : s + n].view(np.uint64), radius)
            if found:
                yield _link_rows(found, k=pa.int64())

        for b in batches:
            if b.num_rows:
                k, fps = np.concatenate([k, b.column(0).to_numpy()]), np.concatenate([fps, b.column(1).to_numpy()])
                cut = int(np.searchsorted(k, k[-1]))
                yield from out(k[:cut], fps[:cut], True)
                k, fps = k[cut:], fps[cut:]
                if len(k) > LARGE:
                    yield from out(k, fps, False)
                    k, fps = k[:0], fps[:0]
        yield from out(k, fps, True)

    met = dealt.select(F.explode(keys).alias("k"), "fp").repartition("k").sortWithinPartitions("k").mapInArrow(meet, "a long, b long, k long")
    met = durable(met)
    large = met.where("k is not null").select("k", F.col("a").alias("fp"))
    rest = F.array(*[F.array(*[F.shiftleft(F.lit(j).cast("long"), 16).bitwiseOR(_field(fp, c, 8)) for j, c in enumerate(combinations(bytes_, 2))]) for bytes_ in _REST])
    within = F.element_at(rest, (F.shiftright("k", 32) + 1).cast("int"))
    finer = large.select("k", "fp", F.explode(within).alias("j")).groupBy("k", "j").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def verify(batches):
        for b in batches:
            yield _link_rows([x for fps in b.column(0).to_pylist() for x in pivot_links(np.array(fps, np.int64).view(np.uint64), radius)])

    return met.where("b is not null").select("a", "b").union(finer.select("fps").mapInArrow(verify, "a long, b long")).distinct()


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS, similar: tuple[int, int] | None = None) -> DataFrame:
    """Rows (id, h, fp, root, component_id), one a row of ``df``: component_id is the smallest id of the documents linked to it.

    ``h`` is the hash of the text and ``root`` names the group. Texts link where their fingerprints differ in at most ``radius``
    bits or, with ``similar`` (a fraction), where their sets of shingles have that Jaccard similarity: SimHash fingerprints and
    pivot tables of a wider radius find these, sets are compared exactly, and pairs beyond that radius have a way of their own, see
    ``near_copies``.
    """
    texts = small_batches(df).select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
    if similar is not None:
        return near_copies.near_copies(texts, id, shingle, similar)
    docs = durable(fingerprints(texts, shingle))
    distinct = durable(docs.groupBy("fp").agg(F.min("id").alias("least")))
    return with_components(docs, distinct, links(distinct, radius), id)


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns; see ``groups.keep_first``."""
    return keep_first(docs, near_duplicates(docs, id, text, **how), id, text)
