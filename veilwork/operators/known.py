"""Known secrets in documents: findings and literal redaction.

Few secrets go to every task as one Aho-Corasick automaton, so a document is read once whatever their number. More than MOST, or
more characters in them than MOST_CHARS, are dealt out: a join finds the secrets that a text may hold, see ``grams``, and an
automaton of these alone reads it. What is kept or replaced is decided by text, over all that it holds, so results do not depend on
how the secrets were dealt, and the memory of a task does not grow with their number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from . import grams

#: Secrets, and characters in them, that every task may hold.
MOST, MOST_CHARS = 2_000, 200_000


class Bank:
    """Some secrets, all looked for at once."""

    def __init__(self, secrets: list[str]):
        import ahocorasick

        self.secrets = secrets
        self.automaton = ahocorasick.Automaton()
        for i, s in enumerate(secrets):
            self.automaton.add_word(s, i)
        if secrets:
            self.automaton.make_automaton()

    def ends(self, text: str):
        """(last place, which secret) of all occurrences."""
        return self.automaton.iter(text) if self.secrets else ()

    def counts(self, text: str) -> dict[str, int]:
        """Occurrences of each secret that do not overlap others of itself."""
        out: dict[str, int] = {}
        end: dict[int, int] = {}
        for last, i in self.ends(text):
            s = self.secrets[i]
            start = last + 1 - len(s)
            if start >= end.get(i, 0):
                out[s] = out.get(s, 0) + 1
                end[i] = last + 1
        return out


_NONE = Bank([])
_built: dict[int, Bank] = {}


def _bank(key: int, secrets: list[str]) -> Bank:
    if key not in _built:
        _built.clear()
        _built[key] = Bank(secrets)
    return _built[key]


def _with_banks(rows: DataFrame, secrets: DataFrame | None, run, schema, more=None, all_rows: bool = True) -> DataFrame:
    """``run`` over pieces of ``rows`` (row, t) and, for each row, a bank of the secrets that its text may hold.

    ``more`` and ``all_rows`` are those of ``grams.with_secrets``.
    """
    few: list[str] = []
    if secrets is not None:
        kept = secrets.select("secret").where("secret <> ''").distinct()
        facts = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("secret")), F.lit(0)).alias("chars")).first()
        if facts["n"] > MOST or facts["chars"] > MOST_CHARS:

            def each(batches):
                for b in grams.slices(batches):
                    yield run(b, (Bank(x) if x else _NONE for x in b.column(2).to_pylist()))

            return grams.with_secrets(rows, kept, more, all_rows).mapInArrow(each, schema)
        few = sorted(r[0] for r in kept.collect())
    shared, key = rows.sparkSession.sparkContext.broadcast(few), uuid.uuid4().int

    def same(batches):
        bank = _bank(key, shared.value)
        for b in grams.slices(batches):
            yield run(b, repeat(bank))

    return rows.mapInArrow(same, schema)


def _hits(docs: DataFrame, secrets: DataFrame, id: str, text: str, counts) -> DataFrame:
    """Rows (id, secret, hits); ``counts`` gives the hits of each secret for a bank and a text."""

    def run(b, banks):
        at, found, hits = [], [], []
        for i, (t, bank) in enumerate(zip(b.column(1).to_pylist(), banks)):  # noqa: B905
            for s, n in sorted(counts(bank, t or "").items()):
                at.append(i)
                found.append(s)
                hits.append(n)
        own = b.column(0).take(pa.array(at, pa.int64())).flatten()[0]
        return pa.RecordBatch.from_arrays([own, pa.array(found, pa.string()), pa.array(hits, pa.int64())], ["id", "secret", "hits"])

    rows = docs.select(F.struct(F.col(id).alias("id")).alias("row"), F.col(text).alias("t"))
    kind = docs.schema[id].dataType.simpleString()
    return _with_banks(rows, secrets, run, f"id {kind}, secret string, hits long", all_rows=False).withColumnRenamed("id", id)


def match_known(docs: DataFrame, secrets: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, secret, hits) for the secrets that occur in a document."""
    return _hits(docs, secrets, id, text, lambda bank, t: bank.counts(t))


def _alternation(bank: Bank, text: str) -> dict[str, int]:
    seen: dict[str, int] = {}
    last = 0
    for start, n, s in sorted((e + 1 - len(bank.secrets[i]), -len(bank.secrets[i]), bank.secrets[i]) for e, i in bank.ends(text)):
        if start >= last:
            last = start - n
            seen[s] = seen.get(s, 0) + 1
    return seen


def alternation_hits(docs: DataFrame, secrets: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, secret, hits) as a literal matcher of all secrets at once finds them: leftmost, longest, none overlapping."""
    return _hits(docs, secrets, id, text, _alternation)


def longest_first(secrets) -> list[str]:
    """The order in which secrets are replaced: a longer one is gone before a part of it is looked for; then by text."""
    return sorted(set(secrets), key=lambda s: (-len(s), s))


def redact_line(text: str, present: list[str]) -> tuple[str, int]:
    """Replace each of ``present`` in turn, longest first, and count."""
    n = 0
    for s in present:
        k = text.count(s)
        if k:
            text, n = text.replace(s, K.REDACTED), n + k
    return text, n


def _strings(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict | list):
        for v in value.values() if isinstance(value, dict) else value:
            yield from _strings(v)


def _decoded(text: str) -> Iterator[str]:
    """Strings inside JSON lines that are written with escapes: a secret may only show in these."""
    for line in text.splitlines():
        if "\\" in line:
            try:
                yield from _strings(json.loads(line))
            except (ValueError, RecursionError):
                pass


def redact_known(docs: DataFrame, secrets: DataFrame, text: str = "text", json_lines: bool = False) -> DataFrame:
    """``docs`` with its text redacted and ``redactions`` counted; ``json_lines``: values of JSON lines first, see ``redact.json_line``."""
    from .redact import json_line

    columns = [c for c in docs.columns if c != "redactions"]
    at = columns.index(text)

    def redacted(t: str, bank: Bank) -> tuple[str, int]:
        found = set(bank.counts(t))
        if not found:
            return t, 0
        if not json_lines:
            return redact_line(t, longest_first(found))
        for s in _decoded(t):
            found.update(bank.counts(s))
        ordered = longest_first(found)
        done = [json_line(line, ordered) for line in t.splitlines(keepends=True)]
        return "".join(x for x, _ in done), sum(k for _, k in done)

    def run(b, banks):
        done = [redacted(t, bank) if t else (t, 0) for t, bank in zip(b.column(1).to_pylist(), banks)]  # noqa: B905
        fields = b.column(0).flatten()[1:]
        fields.insert(at, pa.array([t for t, _ in done], pa.string()))
        return pa.RecordBatch.from_arrays([*fields, pa.array([n for _, n in done], pa.int64())], [*columns, "redactions"])

    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    # The other columns as one value, so that no name can clash; a value before them, as there may be none.
    rest = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in columns if c != text])
    schema = T.StructType([*docs.schema, T.StructField("redactions", T.LongType())])
    return _with_banks(docs.select(rest.alias("row"), F.col(f"`{text}`").alias("t")), secrets, run, schema, _decoded if json_lines else None)
