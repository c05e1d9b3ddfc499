"""Redaction of text streams: framed rows as they come, and raw chunks by a buffer for each stream."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import constants as K
from ..operators import redact


#: Characters of an unfinished token that are held before it is given up as one.
MOST_TOKEN = 65_536
_TOKEN_REST = re.compile(r"[A-Za-z0-9_+/=.:-]*")


def redact_rows(lines: DataFrame, text: str = "value", high_entropy: bool = False) -> DataFrame:
    """One row in, one row out, on a stream or a table: the text and ``redactions``. No state."""
    return redact.redact_short_text(lines, text, high_entropy=high_entropy)


def redact_turns(rows: DataFrame, text: str = "value") -> DataFrame:
    """One row in, one row out, on a stream or a table, where a row may hold many lines: each line is redacted on its own. No state."""
    return redact.redact_lines(rows, text)


class Buffer:
    """Cuts what arrives into lines, and input without line ends into pieces that cut no secret.

    ``strict`` passes lines beyond the short-text limit on unchanged, as the short-text rule has it; otherwise they are redacted in
    pieces as well.
    """

    def __init__(self, pending: str = "", most: int = 8192, high_entropy: bool = False, strict: bool = False, inside: bool = False):
        self.pending, self.most, self.high, self.strict = pending, max(1, min(most, 8192)), high_entropy, strict
        self.inside = inside  # a token that was given up, whose rest goes unseen
        self.ahead = min(256, self.most)

    def _piece(self) -> tuple[str, int] | None:
        out, used, n = redact.safe_prefix(self.pending[: self.most + self.ahead], self.most, high_entropy=self.high)
        if not used:
            return None
        self.pending = self.pending[used:]
        return out, n

    def _open_token(self) -> tuple[str, int]:
        """A token longer than any real one goes out as redacted; what follows is taken as its rest while it looks like it."""
        self.inside = True
        self._skip()
        return K.REDACTED, 1

    def _skip(self) -> None:
        rest = _TOKEN_REST.match(self.pending).end()
        self.inside, self.pending = rest == len(self.pending), self.pending[rest:]

    def feed(self, chunk: str) -> Iterator[tuple[str, int]]:
        self.pending += chunk
        if self.inside:
            self._skip()
        while self.pending:
            at = self.pending.find("\n")
            if at >= 0 and (self.strict or at < K.SHORT_TEXT_CHARS):
                line, self.pending = self.pending[: at + 1], self.pending[at + 1 :]
                yield redact.short_text(line, self.high)
            elif len(self.pending) >= self.most + self.ahead:
                piece = self._piece()
                if piece is not None:
                    yield piece
                elif len(self.pending) < 2 * MOST_TOKEN:
                    return
                else:
                    yield self._open_token()
            else:
                return

    def finish(self) -> Iterator[tuple[str, int]]:
        if self.pending:
            out, _, n = redact.safe_prefix(self.pending, len(self.pending), high_entropy=self.high)
            self.pending = ""
            yield out, n


OUT = "stream string, seq long, text string, redactions long"
STATE = "pending string, seq long, inside boolean"


def redact_chunks(chunks: DataFrame, most: int = 8192, high_entropy: bool = False, strict: bool = False, idle: str | None = None) -> DataFrame:
    """Rows (stream, seq, text, redactions) from a stream of (stream, seq, chunk, is_last).

    A stream's rest stays in its state until more arrives, a chunk says it is the last, or, with ``idle`` (such as "10 minutes"),
    nothing has come for that long: then the rest goes out and the state goes. Chunks of a batch are taken by ``seq``.
    """
    kind = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout

    wait = 0 if idle is None else int(pd.Timedelta(idle) / pd.Timedelta(milliseconds=1))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, seq, inside = state.get if state.exists else ("", 0, False)
        buffer = Buffer(pending, most, high_entropy, strict, inside)
        pieces = []
        last = idle is not None and state.hasTimedOut
        if last:
            pieces += list(buffer.finish())
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            for chunk, end in zip(rows["chunk"], rows["is_last"], strict=True):
                pieces += list(buffer.feed(chunk or ""))
                if end:
                    pieces += list(buffer.finish())
                    last = True
        if last:
            state.remove()
        else:
            state.update((buffer.pending, seq + len(pieces), buffer.inside))
            if idle is not None:
                state.setTimeoutDuration(wait)
        yield pd.DataFrame({"stream": [key[0]] * len(pieces), "seq": range(seq, seq + len(pieces)), "text": [t for t, _ in pieces], "redactions": [n for _, n in pieces]})

    return chunks.groupBy("stream").applyInPandasWithState(run, OUT, STATE, "append", kind)


def until_detected(lines: DataFrame, sink, text: str = "value", high_entropy: bool = False):
    """Start a query that hands each redacted batch to ``sink(batch, redactions)`` and stops after the first that had a secret."""
    holder = {}

    def each(batch, _):
        redacted = redact_rows(batch, text, high_entropy).cache()
        n = redacted.agg({"redactions": "sum"}).first()[0] or 0
        sink(redacted, n)
        redacted.unpersist()
        if n and "q" in holder:
            holder["q"].stop()

    holder["q"] = lines.writeStream.foreachBatch(each).start()
    return holder["q"]
