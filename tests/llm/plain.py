"""What operators must give, written again in the plainest way."""

import re
import zlib
from math import exp

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"(AKIA[A-Z0-9]+)"),
    ("hex", r"([0-9a-f]+)"),
    ("github", r"(gh[pousr]_[0-9A-Za-z]{36})(?![0-9A-Za-z])"),
    ("npm", r"(npm_[0-9A-Za-z]{36})(?![0-9A-Za-z])"),
]
LEAST = {"assign": 6, "access": 20, "hex": 24}


def checksum_holds(token):
    n, want = zlib.crc32(token[4:34].encode()), ""
    while len(want) < 6:
        want, n = DIGITS[n % 62] + want, n // 62
    return token[34:] == want


def spans(text):
    """(start, place of the kind, end, start of the secret), in order."""
    out = []
    for i, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            if checksum_holds(m[1]) if kind not in LEAST else len(m[1]) >= LEAST[kind]:
                out.append((m.start(), i, m.end(), m.start(1)))
    return sorted(out)


def redacted(text):
    """Each character that is part of a secret goes; a run of overlapping secrets leaves one mark."""
    out, at = "", 0
    for start, end in sorted((value, end) for _, _, end, value in spans(text)):
        if start >= at:
            out, at = out + text[at:start] + "[SECRET]", end
        at = max(at, end)
    return out + (text or "")[at:]


def score(model, text):
    """The machine's sum over all pairs of terms."""
    found = set()
    for token in (text or "").split():
        for w in re.findall(r"[^\W\d_]+", token.lower()):
            for term in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) >= n)]:
                place = zlib.crc32(term.encode()) >> 12
                if place in model.row:
                    found.add(model.row[place])
    rows = sorted(found)
    z = float(model.w0) + sum(float(model.w[i]) for i in rows)
    for k, i in enumerate(rows):
        for j in rows[:k]:
            z += sum(float(a) * float(b) for a, b in zip(model.v[i], model.v[j], strict=True))
    return 1 / (1 + exp(-min(35.0, max(-35.0, z))))


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        for s in over or open_:
            target[s] = cap * sizes[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def rates(sizes, target, cap=3):
    """The tilts of one source's documents, by bisection of its multiplier."""
    bands = [n.bit_length() for n in sizes]
    total = sum(sizes)
    if not total:
        return [1.0] * len(sizes)
    mean = sum(b * n for b, n in zip(bands, sizes, strict=True)) / total
    tilt = lambda lam, b: min(cap, exp(min(700.0, lam * b / mean)))
    lo, hi = -700.0, 700.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(n * tilt(mid, b) for b, n in zip(bands, sizes, strict=True)) < target else (lo, mid)
    return [tilt(lo, b) if n else 1.0 for b, n in zip(bands, sizes, strict=True)]
