"""Secret scan: keyword automaton, anchored expressions near its hits, embedded checksums.

One Aho-Corasick automaton runs over the lower-cased text; an expression is only tried at the place of a keyword of its own.
Tokens that carry a checksum are reported if it holds. Runs of hexadecimal digits have no keyword and take one plain scan.
Offsets count code points, ends are exclusive.

Cases: null text is empty and gives no spans; repeated rows are scanned each; overlapping kinds are all reported, ties at one start
in the order of the kinds; whole texts are read, however long; an empty table gives no rows; columns of the input may have any names.
Nothing is shuffled, so skew and hot groups do not matter.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import slices, small_batches

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm")

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
#: Keyword in lower case -> kind.
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "api_key", "apikey"), "assign"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"),
    "npm_": "npm",
}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


class Span(NamedTuple):
    start: int
    kind: int  # index in KINDS
    end: int
    value: int  # where the secret itself starts


def checksum(body: str) -> str:
    """CRC-32 of the body in six digits of base 62."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out


_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        built = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            built.add_word(word, (kind, len(word)))
        built.make_automaton()
        _automaton = built
    return _automaton


def scan(text: str) -> list[Span]:
    """All spans by start, then kind."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = text.translate(_UPPER)
    out = []
    done = dict.fromkeys(KINDS, 0)  # matches of a kind do not overlap, dropped ones included
    for end, (kind, n) in automaton().iter(lower):
        start = end + 1 - n
        if start < done[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(text, start):
                done[kind] = m.end()
                if m.end(2) - m.start(2) >= 6:
                    out.append(Span(m.start(), 0, m.end(), m.start(2)))
        elif kind == "access":
            if m := _ACCESS.match(text, start):
                done[kind] = m.end()
                if m.end() - m.start() >= 20:
                    out.append(Span(m.start(), 1, m.end(), m.start()))
        elif m := (_GITHUB if kind == "github" else _NPM).match(text, start):
            done[kind] = m.end()
            if checksum(m[1]) == m[2]:
                out.append(Span(m.start(), KINDS.index(kind), m.end(), m.start()))
    out += [Span(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with the secret of each span replaced once; overlapping ones count as one."""
    out, at = [], 0
    for start, end in sorted((s.value, s.end) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int,value:int>>"


def scan_documents(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, spans), one a row of ``df``."""

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int32())]))
        for b in slices(batches):
            spans = [[{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "value": s.value} for s in scan(t)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["id", "spans"])

    schema = f"id {df.schema[id].dataType.simpleString()}, spans {SPANS}"
    return small_batches(df).select(F.col(id).alias("id"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id)


def redact_documents(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs`` with the secrets of the text replaced; ``n_chars``, if there, follows."""
    at = docs.columns.index(text)

    def run(batches):
        for b in slices(batches):
            new = pa.array([redact(t, scan(t), mark) if t else t for t in b.column(at).to_pylist()], pa.string())
            columns = [new if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    out = small_batches(docs).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        changed = F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
