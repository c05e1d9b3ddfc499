"""Near copies by the exact Jaccard similarity of their sets of shingles: what ``simhash.near_duplicates`` does with ``similar``.

SimHash fingerprints of 64 bits and pivot distance tables find the pairs, exact comparison of the sets decides. Texts of similarity
0.8 differ in ten bits on average, so the radius is RADIUS bits. At that radius neither blocks of bits nor a join on coordinates
keep random fingerprints apart (``simhash`` can do that for two bits only), so keys of another kind come first. And as no
radius holds every pair that is similar, those beyond it have a way of their own, which loses none.

1. Keys. Two sets with similarity p/q or more share a member among the first ``n - ceil(n * p / q) + 1`` of each, whatever the
   order that both are put in, so every pair that counts meets under a key. The order takes shingles that are frequent in a sample
   last, which makes groups small; the links found do not depend on it.
2. SimHash and pivot tables (``pivots``). Of all pairs that meet, the tables discard those that cannot be within the radius, XOR
   verifies the others, and what is within it goes to 4 at once. Pairs of small groups are asked for one by one; groups beyond
   SMALL in blocks, which give a spanning forest, never their pairs.
3. The rest: pairs beyond the radius. A parity fingerprint has about as many bits as there are shingles, and each shingle flips one.
   Sets that differ in d members have fingerprints that differ in at most d bits, so a larger distance than similar sets can have
   discards a pair for certain; others go to 4 as well.
4. Sets. What is left is joined to candidate groups, and only the texts in these are read again. Inside a candidate group all
   sets are compared exactly, in blocks by products of their incidence matrices, which again give spanning forests.

What is shuffled: about a fifth of the shingles as (key, print, size), the fingerprints of both sides of each pair met, and the sets
of texts that have a copy or nearly one. A group of c near copies costs c * c comparisons, spread over blocks.

Cases: words are those of the fingerprints; a text of fewer words is one shingle; texts without words, null ones too, are copies
of each other; equal sets are one before any comparison; repeated rows are kept. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pivots
from ._util import durable, release, sieve, slices
from .groups import components, with_components
from .shingles import shingles

#: Bits that SimHash fingerprints of similar sets differ in, but for few, which the parity fingerprints find.
RADIUS = 16
#: Groups up to this size give their pairs.
SMALL = 64
#: About how many texts the sample of frequent shingles takes, and how many of those shingles the order knows.
SAMPLE, FREQUENT = 20_000, 200_000
#: Members and shingles of a block of a large group.
BLOCK_ROWS, BLOCK_SHINGLES = 1500, 500_000
#: Rows of one key that a task holds at once.
HELD = 100_000
#: Sets that a task remembers to name the keys of copies once.
SEEN = 200_000
#: Bits of a parity fingerprint at most, as a power of two.
MOST_BITS = 16


def digest(members: np.ndarray) -> int:
    """One signed long a set; 0 for the empty one."""
    return int(np.array(xxhash.xxh64_intdigest(members.tobytes(), 7), np.uint64).view(np.int64)) if len(members) else 0


def reach(similar: tuple[int, int], inter, a, b):
    """Whether sets of ``a`` and ``b`` members with ``inter`` in common are similar; also on arrays."""
    return (similar[0] + similar[1]) * inter >= similar[0] * (a + b)


def sizes_fit(similar: tuple[int, int], a, b):
    return similar[1] * np.minimum(a, b) >= similar[0] * np.maximum(a, b)


def simhash(members: np.ndarray) -> int:
    """The SimHash fingerprint of a set as a signed number, 0 for the empty one."""
    return int(np.array(pivots.majority(pivots.byte_counts(members), len(members)), np.uint64).view(np.int64)) if len(members) else 0


# Parity fingerprints ---------------------------------------------------------------------------------------------------


def parity(members: np.ndarray) -> bytes:
    """One bit a place: whether an odd number of members fall on it; more places than members, up to the most."""
    bits = 1 << min(MOST_BITS, max(6, len(members).bit_length()))
    counts = np.bincount((members & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts.astype(np.uint8) & 1, bitorder="little").tobytes()


def fold(x: int, have: int, want: int) -> int:
    """The parity fingerprint of fewer places (numbers of bytes, powers of two)."""
    while have > want:
        have //= 2
        x = (x >> 8 * have) ^ (x & ((1 << 8 * have) - 1))
    return x


def may_reach(similar: tuple[int, int], distance, a, b):
    """False only if sets of ``a`` and ``b`` members at this distance are not similar."""
    return (similar[0] + similar[1]) * distance <= (similar[1] - similar[0]) * (a + b)


def near_prints(one: bytes, two: bytes, a: int, b: int, similar: tuple[int, int]) -> bool:
    n = min(len(one), len(two))
    x, y = fold(int.from_bytes(one, "little"), len(one), n), fold(int.from_bytes(two, "little"), len(two), n)
    return may_reach(similar, (x ^ y).bit_count(), a, b)


def spanning(n: int, near) -> list[tuple[int, int]]:
    """Links of a spanning forest of ``n`` things; ``near(i, others)`` tells which of the others are near i."""
    left, links = np.arange(n), []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near(i, left)
            found = left[hit].tolist()
            left = left[~hit]
            links += [(i, j) for j in found]
            todo += found
    return links


def print_forest(prints: list[bytes], sizes: np.ndarray, similar: tuple[int, int], sims: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (by place) of a spanning forest of those within ``radius`` by their SimHash fingerprints ``sims`` (unsigned), and of the others whose parity fingerprints do not rule similarity out."""
    rows = None if sims is None else pivots.table(sims)
    lengths = np.array([len(p) for p in prints])
    # By length: each fingerprint at its own and, as sizes differ by less than twice, at half of it.
    tables: dict[int, np.ndarray] = {}
    for n in np.unique(lengths).tolist():
        table = np.zeros((len(prints), n // 8), np.uint64)
        for at in np.flatnonzero((lengths == n) | (lengths == 2 * n)).tolist():
            x = fold(int.from_bytes(prints[at], "little"), len(prints[at]), n)
            table[at] = np.frombuffer(x.to_bytes(n, "little"), np.uint64)
        tables[n] = table

    def near(i: int, others: np.ndarray) -> np.ndarray:
        out = sizes_fit(similar, sizes[i], sizes[others])
        rest = out.copy()
        if rows is not None:
            at = np.flatnonzero(out)
            rest[at[pivots.within(rows, sims, np.full(len(at), i), others[at], radius)]] = False
        for n in np.unique(lengths[others[rest]]).tolist():
            at = np.flatnonzero(rest & (lengths[others] == n))
            table = tables[min(n, int(lengths[i]))]
            distance = np.bitwise_count(table[others[at]] ^ table[i]).sum(1, dtype=np.int64)
            out[at] = may_reach(similar, distance, sizes[i], sizes[others[at]])
        return out

    return spanning(len(prints), near)


# Keys ------------------------------------------------------------------------------------------------------------------


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sets(column) -> list[np.ndarray]:
    return [s.values.to_numpy() for s in column]


def frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in three or more of the sampled distinct texts, sorted, and in how many."""
    # Chosen by the hash of the text, so no text moves but those of the sample.
    share = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.col("h"), F.lit(share)) == 0).where("t is not null").dropDuplicates(["h"])

    def make(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([_lists([shingles(t, shingle) for t in b.column(0).to_pylist()])], ["s"])

    counts = sample.select("t").mapInArrow(make, "s array<long>").select(F.explode("s").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    got = counts.where("n >= 3").orderBy(F.desc("n"), "s").limit(FREQUENT).toArrow()
    s, n = got.column("s").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def prefix(members: np.ndarray, common: np.ndarray, counts: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """The first members in the order of (count in the sample, hash), so many that similar sets share one."""
    k = len(members) - -(-len(members) * similar[0] // similar[1]) + 1 if len(members) else 0
    if not len(common):
        return members[:k]
    at = np.minimum(np.searchsorted(common, members), len(common) - 1)
    n = np.where(common[at] == members, counts[at], 0)
    return members[np.argsort(n, kind="stable")[:k]]


def keyed(texts: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """Rows (id, h, fp, n, sim, bits, keys) of ``texts`` (id, h, t); a task gives fingerprints and keys of equal sets once."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent(texts, shingle))

    def make(batches):
        seen = set()
        for b in slices(batches):
            fps, sizes, sims, bits, keys = [], [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingles(t, shingle)
                fp = digest(s)
                again = fp in seen
                fps.append(fp)
                sizes.append(len(s))
                sims.append(None if again else simhash(s))
                bits.append(None if again else parity(s))
                keys.append(s[:0] if again else prefix(s, *shared.value, similar))
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(fp)
            own = [pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sims, pa.int64()), pa.array(bits, pa.binary()), _lists(keys)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *own], ["id", "h", "fp", "n", "sim", "bits", "keys"])

    return texts.mapInArrow(make, f"id {texts.schema['id'].dataType.simpleString()}, h long, fp long, n int, sim long, bits binary, keys array<long>")


MET = {"a": pa.int64(), "b": pa.int64(), "key": pa.int64(), "block": pa.int32(), "n": pa.int32()}


def _rows(**columns) -> pa.RecordBatch:
    size = len(columns["a"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in MET.items()], list(MET))


def _small(key: np.ndarray, n: np.ndarray, fp: np.ndarray, similar: tuple[int, int]) -> pa.RecordBatch:
    """The pairs of small groups; rows are sorted by key."""
    found = []
    for d in range(1, SMALL):
        x = np.flatnonzero(key[d:] == key[:-d])
        if not len(x):
            break
        x = x[sizes_fit(similar, n[x], n[x + d])]
        found.append((np.minimum(fp[x], fp[x + d]), np.maximum(fp[x], fp[x + d])))
    a, b = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (fp[:0], fp[:0])
    pairs = np.unique(np.stack([a, b], axis=1), axis=0)
    return _rows(a=pairs[:, 0], b=pairs[:, 1])


def meetings(keys: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """For all groups of rows (key, n, fp) with one key: pairs (a, b) of the small ones, members (a, key, block, n) of the large ones.

    Rows come sorted, a key's by size. What a task holds is bounded: a key with more than SMALL rows goes out block by block.
    """

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        open_key, block, filled = None, 0, 0
        gone = None  # the last row of a part of a group that went out

        def large(key, n, fp):
            nonlocal open_key, block, filled
            if open_key != key:
                open_key, block, filled = key, 0, 0
            while len(n):
                # As many as the block still takes.
                shingle_room = max(1, BLOCK_SHINGLES // max(1, int(n[-1])))
                room = min(BLOCK_ROWS, shingle_room) - filled
                if room <= 0:
                    block, filled = block + 1, 0
                    continue
                yield _rows(a=fp[:room], key=np.full(len(fp[:room]), key), block=np.full(len(fp[:room]), block), n=n[:room])
                filled += len(fp[:room])
                n, fp = n[room:], fp[room:]

        def out(key, n, fp, last: bool):
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
            if len(key) and gone == (key[0], fp[0]):
                new[0] = False
            key, n, fp = key[new], n[new], fp[new]
            if not len(key):
                return
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(start, len(key)))
            many = (count > SMALL) | (key[start] == open_key)
            many[-1] |= not last
            for s, c in zip(start[many].tolist(), count[many].tolist(), strict=True):
                yield from large(int(key[s]), n[s : s + c], fp[s : s + c])
            few = np.repeat(~many & (count > 1), count)
            if few.any():
                yield _small(key[few], n[few], fp[few], similar)

        for b in batches:
            if not b.num_rows:
                continue
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield from out(*(c[:cut] for c in held), True)
                held = [c[cut:] for c in held]
            if len(held[0]) > HELD:
                yield from out(*held, False)
                gone = held[0][-1], held[2][-1]
                held = [c[-1:] for c in held]  # once more, as copies of it may follow
        yield from out(*held, True)
        release()

    return keys.repartition("key").sortWithinPartitions("key", "n", "fp").mapInArrow(run, "a long, b long, key long, block int, n int")


# Candidates and links --------------------------------------------------------------------------------------------------


def block_pairs(members: DataFrame, similar: tuple[int, int], *keys: str) -> DataFrame:
    """``members`` (*keys, block, n, ...) for each pair of blocks (block, other) of a group that can hold similar sets."""
    ranges = durable(members.groupBy(*keys, "block").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    one, two = ranges.withColumnRenamed("block", "i"), ranges.withColumnsRenamed({"block": "j", "least": "least2", "most": "most2"})
    fits = (F.col("most") * similar[1] >= F.col("least2") * similar[0]) & (F.col("most2") * similar[1] >= F.col("least") * similar[0])
    pairs = one.join(two, list(keys)).where("i <= j").where(fits).select(*keys, "i", "j")
    sides = pairs.select(*keys, "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return members.join(sides, [*keys, "block"])


def unsigned(column) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def candidates(docs: DataFrame, distinct: DataFrame, similar: tuple[int, int], radius: int = RADIUS) -> DataFrame:
    """Rows (a, b): links that join all sets within ``radius`` that meet under a key, and all others that may be similar."""
    met = durable(meetings(docs.select(F.explode("keys").alias("key"), "n", "fp"), similar))
    prints = distinct.select("fp", "n", "sim", "bits")
    side = lambda x: prints.select(F.col("fp").alias(x), *[F.col(c).alias(c + x) for c in ("n", "sim", "bits")])
    pairs = met.where("b is not null").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")

    def test(batches):
        for b in batches:
            keep = pivots.pairs_within(unsigned(b.column("sima")), unsigned(b.column("simb")), radius)
            rest = b.filter(pa.array(~keep))
            rows = zip(*(rest.column(c).to_pylist() for c in ("bitsa", "bitsb", "na", "nb")), strict=True)
            keep[~keep] = [near_prints(*r, similar) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))
        release()

    def grow(table):
        fps = table.column("a").to_pylist()
        found = print_forest(table.column("bits").to_pylist(), table.column("n").to_numpy().astype(np.int64), similar, unsigned(table.column("sim")), radius)
        if table.num_rows > SMALL:
            release()
        return pa.table({"a": pa.array([fps[i] for i, _ in found], pa.int64()), "b": pa.array([fps[j] for _, j in found], pa.int64())})

    passed = pairs.select("a", "b", "sima", "simb", "bitsa", "bitsb", "na", "nb").mapInArrow(test, "a long, b long")
    large = block_pairs(met.where("key is not null").select("a", "key", "block", "n"), similar, "key").select("a", "key", "i", "j", "n")
    grown = large.join(prints.select(F.col("fp").alias("a"), "sim", "bits"), "a").groupBy("key", "i", "j").applyInArrow(grow, "a long, b long")
    return passed.union(grown)


def forest(sets: list[np.ndarray], similar: tuple[int, int]) -> list[tuple[int, int]]:
    """Links (by place) of a spanning forest of the similar ones among ``sets``."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    _, term, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    row, term = row[count[term] > 1], term[count[term] > 1]
    _, term = np.unique(term, return_inverse=True)
    order = np.argsort(term, kind="stable")
    row, term = row[order], term[order]
    inter, step = np.zeros((n, n), np.float32), 4096
    for a in range(0, int(term[-1]) + 1 if len(term) else 0, step):
        lo, hi = np.searchsorted(term, [a, a + step])
        x = np.zeros((n, min(step, int(term[-1]) + 1 - a)), np.float32)
        x[row[lo:hi], term[lo:hi] - a] = 1
        inter += x @ x.T
    near = np.zeros((n, n), bool)
    for a in range(0, n, 256):  # whole numbers of 64 bits for a part of the rows at a time
        near[a : a + 256] = reach(similar, inter[a : a + 256].astype(np.int64), sizes[a : a + 256, None], sizes[None, :])
    del inter
    return spanning(n, lambda i, others: near[i, others])


def links(texts: DataFrame, docs: DataFrame, distinct: DataFrame, shingle: int, similar: tuple[int, int], radius: int = RADIUS) -> DataFrame:
    """Rows (a, b) that link all similar sets: ``docs`` are the rows of ``keyed``, ``distinct`` the rows (fp, least, n, sim, bits)."""
    close = durable(components(candidates(docs, distinct, similar, radius)))
    wanted = durable(distinct.join(close, F.col("fp") == F.col("node")).select("least", "fp", "n", "root"))

    def make(batches):
        for b in slices(batches):
            found = [shingles(t, shingle) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in found], pa.int64()), _lists(found)], ["fp", "s"])

    # Only texts whose id a sieve lets through are moved.
    ids = wanted.select(F.col("least").alias("_id")).distinct()
    met = texts.where(sieve(F.xxhash64("id"), ids.select(F.xxhash64("_id").alias("key"))))
    sets = met.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("t").mapInArrow(make, "fp long, s array<long>")
    sets = durable(sets.dropDuplicates(["fp"]).join(wanted.select("fp", "n", "root"), "fp"))

    def number(batches):
        """Blocks of a group, by size."""
        last, block, rows, total = None, 0, 0, 0
        for b in batches:
            out = []
            for root, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if root != last:
                    last, block, rows, total = root, 0, 0, 0
                elif rows >= BLOCK_ROWS or total + n > BLOCK_SHINGLES:
                    block, rows, total = block + 1, 0, 0
                rows, total = rows + 1, total + n
                out.append(block)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], ["root", "n", "fp", "block"])

    placed = sets.select("root", "n", "fp").repartition("root").sortWithinPartitions("root", "n", "fp").mapInArrow(number, "root long, n int, fp long, block int")
    asked = block_pairs(durable(placed), similar, "root").select("root", "i", "j", "fp")

    def grow(table):
        fps = table.column("fp").to_pylist()
        found = forest(_sets(table.column("s")), similar)
        if table.num_rows > SMALL:
            release()
        return pa.table({"a": pa.array([fps[i] for i, _ in found], pa.int64()), "b": pa.array([fps[j] for _, j in found], pa.int64())})

    return asked.join(sets.select("fp", "s"), "fp").select("root", "i", "j", "fp", "s").groupBy("root", "i", "j").applyInArrow(grow, "a long, b long")


def near_copies(texts: DataFrame, id: str, shingle: int = 5, similar: tuple[int, int] = (4, 5), radius: int = RADIUS) -> DataFrame:
    """Rows (id, h, fp, root, component_id), one a row of ``texts`` (id, h, t); component_id is the smallest id of those linked to it."""
    docs = durable(keyed(texts, shingle, similar))
    distinct = durable(docs.groupBy("fp").agg(F.min("id").alias("least"), *[F.max(c).alias(c) for c in ("n", "sim", "bits")]))
    return with_components(docs.select("id", "h", "fp"), distinct.select("fp", "least"), links(texts, docs, distinct, shingle, similar, radius), id)
