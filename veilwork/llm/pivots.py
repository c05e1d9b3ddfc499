"""SimHash bits of hashed shingles, and pivot distance tables that tell fingerprints apart at a wide radius.

A row of the table holds a fingerprint's Hamming distances to REFERENCES fixed reference fingerprints, each cut into BLOCKS blocks
of four bits. In a block the triangle inequality bounds the difference of two distances by the number of bits that differ there, so
over the blocks of one reference the differences add up to at most the Hamming distance: a larger sum discards a pair for certain.
Whole distances would not do at this radius: two random fingerprints differ in about 32 bits, but their distances to a reference
in 6. The sums are about 17. What is left is verified bit by bit.
"""

from __future__ import annotations

import numpy as np

REFERENCES = np.random.default_rng(42).integers(0, 1 << 64, 24, np.uint64)
BLOCKS = 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_COLUMNS = (np.arange(8) * 256)[None, :]


def byte_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each byte value stands at each of the eight places."""
    counts = np.zeros(2048, np.int64)
    for a in range(0, len(hashes), 8192):  # the places take eight times the memory of the hashes
        counts += np.bincount((hashes[a : a + 8192].view(np.uint8).reshape(-1, 8) + _COLUMNS).ravel(), minlength=2048)
    return counts.reshape(8, 256)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes: a bit is 1 if set in over half of them."""
    return int(np.packbits((2 * (counts @ _BITS) > n).ravel(), bitorder="little").view(np.uint64)[0])


def table(fps: np.ndarray) -> np.ndarray:
    """Distances by (reference, fingerprint, block)."""
    apart = (fps[None, :] ^ REFERENCES[:, None]).view(np.uint8).reshape(len(REFERENCES), len(fps), 8)
    return np.bitwise_count(np.concatenate([apart & 15, apart >> 4], axis=2)).astype(np.int8)


class Pairs:
    """How many pairs were met, left by the pivot table, and near."""

    met = left = near = 0


def within(rows: np.ndarray, fps: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int, pairs: Pairs | None = None) -> np.ndarray:
    """Whether the fingerprints at the places ``x`` and ``y`` differ in at most ``radius`` bits; ``rows`` is the table of ``fps``."""
    at = np.arange(len(x))
    for distances in rows:
        if not len(at):
            break
        at = at[np.abs(distances[x[at]] - distances[y[at]]).sum(1) <= radius]
    out = np.zeros(len(x), bool)
    out[at] = np.bitwise_count(fps[x[at]] ^ fps[y[at]]) <= radius
    if pairs:
        pairs.met, pairs.left, pairs.near = pairs.met + len(x), pairs.left + len(at), pairs.near + int(out.sum())
    return out


def pairs_within(one: np.ndarray, two: np.ndarray, radius: int, pairs: Pairs | None = None) -> np.ndarray:
    """``within`` for pairs of fingerprints side by side; each has its row of the table made once."""
    fps, place = np.unique(np.concatenate([one, two]), return_inverse=True)
    return within(table(fps), fps, place[: len(one)], place[len(one) :], radius, pairs)
