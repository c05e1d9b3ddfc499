"""White-space words of long texts in blocks, and their shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

#: Long texts are cut into words in blocks of so many bytes.
BLOCK = 4_000_000
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def blocks(data: bytes) -> Iterator[bytes]:
    """Parts of about BLOCK bytes that cut no word."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > BLOCK:
            m = _GAP.search(data, at + BLOCK)
            end = m.start() if m else end
        yield data[at:end]
        at = end


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of the distinct shingles of the lower-cased words, sorted; a text of fewer words is one shingle."""
    found, tail, hashed = [], [], xxhash.xxh64_intdigest
    for block in blocks((text or "").encode("utf-8", "surrogatepass").lower()):  # bytes.lower() is A-Z only, as is bytes.split() white space
        words = tail + block.split()
        k = len(words) - shingle + 1
        if k > 0:
            parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
            found.append(np.unique(np.fromiter((hashed(p, 42) for p in parts), np.uint64, k)))
            tail = words[k:]
        else:
            tail = words
    if not found:
        return np.array([hashed(b" ".join(tail), 42)] if tail else [], np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))
