"""Token ids and token counts with caches of words, exact for whole texts.

Both vocabularies split a text into pre-tokens before any merge, so a piece of text that is cut at pre-token borders has
the same ids on its own. Texts made of characters for which those borders are known here are cut with string methods and
looked up; any other text (combining marks, other scripts, control characters, special strings) goes whole through the
library. Either way the result is the library's.

Cases of ``count_tokens``: null and empty texts have 0 tokens; repeated rows are counted each; which of equally frequent pieces enter
the table changes no count; very long texts are counted whole; an empty table gives no rows; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import slices, small_batches, sole

#: Characters whose class and case are the same in every Unicode version: Latin letters, common signs, plain white space.
_OTHER = re.compile("[^\\t\\n\\x0b\\x0c\\r -~¡-įı-ňŊ-žƀ-ǃǍ-ǰ‐-‧‰-⁞€]")
#: Special strings hold this in both vocabularies; such texts take the library's way.
_SPECIAL = "<|"
#: Words a worker's cache holds before it keeps only those of the texts at hand.
CACHE = 450_000
#: Pre-tokens inside words that it holds beside.
PARTS = 50_000
#: Longer words are not nominated.
LONG_WORD = 200
#: Words that a task nominates for the table of frequent words, and those that the table holds.
NOMINEES, FREQUENT = 2048, 32_768


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer of ``path``, once a Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def worker(kind, path: str, key: int = 0, frozen=None):
    """The encoder of this Python worker, which outlives its tasks; a new table of frequent words replaces it."""
    return sole((kind, path, key), lambda: kind(path, *([frozen.value] if frozen is not None else [])))


def plain(text: str) -> bool:
    return not _OTHER.search(text) and _SPECIAL not in text


_PLAIN = [chr(i) for i in range(0x2100) if not _OTHER.match(chr(i))]
_LETTERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N")
_SIGNS = f"[^\\s{_LETTERS}{_NUMBERS}]"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: The pre-tokens of the two vocabularies, for plain characters.
WORD_PIECES = re.compile(f"{_SHORT}|[{_LETTERS}]+|[{_NUMBERS}]|{_SIGNS}+")
BYTE_PIECES = re.compile(f"{_SHORT}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?{_SIGNS}+|\\s+(?!\\S)|\\s+")
#: The signs that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_SPACE = chr(_SHOWN[32])


class _Known(dict):
    """Words and their values; a missing one is learnt when it is asked for."""

    def __init__(self, learn, held: dict):
        super().__init__(held)
        self.learn = learn

    def __missing__(self, word: str):
        value = self[word] = self.learn(word)
        return value


class Words:
    """A worker's cache from words to values that add up over pre-tokens; the frozen part outlives every reset.

    ``lead`` is what precedes a word where it is encoded. A missing word is cut into its pre-tokens here and only these go through the
    library's model, which spares what the library does around it.
    """

    def __init__(self, tok, pieces: re.Pattern, value, add, lead: str, frozen: dict | None = None):
        # ``value`` takes the tokens of a pre-token, ``add`` the values of several.
        self.merge, self.find, self.value, self.add, self.lead, self.frozen = tok.model.tokenize, pieces.findall, value, add, lead, frozen or {}
        self.known, self.parts, self.most = _Known(self.learn, self.frozen), {}, CACHE

    def part(self, piece: str):
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", _SPACE)
        else:
            shown = piece.encode().decode("latin-1").translate(_SHOWN)
        return self.value(self.merge(shown))

    def whole(self, text: str):
        """The value of a text of plain characters."""
        parts, out = self.parts, []
        for p in self.find(text):
            if p not in parts:
                parts[p] = self.part(p)
            out.append(parts[p])
        return self.add(out)

    def learn(self, word: str):
        return self.part(self.lead + word) if word.isalpha() else self.whole(self.lead + word)

    def combine(self, lists: list[list[str] | None], join) -> list:
        """``join`` of the values of each list; None stays."""
        get = self.known.__getitem__
        out = [None if ws is None else join(map(get, ws)) for ws in lists]
        if len(self.known) > self.most + len(self.frozen):
            # Frequent words are among those of the texts at hand.
            here = set().union(*(ws for ws in lists if ws is not None)).union(self.frozen)
            self.known = _Known(self.learn, {w: get(w) for w in here})
        if len(self.parts) > PARTS:
            self.parts.clear()
        return out


def groups(texts: list, size: int = 1_000_000) -> Iterator[list]:
    """Runs of texts of about ``size`` characters."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t)
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


class WordIds:
    """Ids of ``word_bpe_49k.json``: lower case, words end at white space."""

    def __init__(self, path: str):
        self.tok = load(path)
        as_bytes = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]
        self.words = Words(self.tok, WORD_PIECES, lambda tokens: b"".join([as_bytes[t.id] for t in tokens]), b"".join, "")

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        for run in groups(texts):
            found = self.words.combine([t.lower().split() if plain(t) else None for t in run], b"".join)
            for t, ids in zip(run, found, strict=True):
                yield np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if ids is None else ids


#: A space that ends a word and starts the next: the only place where texts are cut for byte_bpe_50k.json.
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")
_RUN = re.compile(r"\s ")


def cut(text: str) -> list[str]:
    """Pieces whose tokens, the space before all but the first included, are the text's."""
    return _CUT.split(text) if _RUN.search(text) else text.split(" ")


class TokenCounts:
    """Token counts of ``byte_bpe_50k.json``; ``frequent``: counts of frequent pieces with the space before them."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        self.tok = load(path)
        self.words = Words(self.tok, BYTE_PIECES, len, sum, " ", frequent)

    def count(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> Iterator[int]:
        for run in groups(texts):
            lists = [cut(t) if plain(t) else None for t in run]
            heads = iter([self.words.whole(x[0]) for x in lists if x is not None])
            found = self.words.combine([x if x is None else x[1:] for x in lists], sum)
            for t, n in zip(run, found, strict=True):
                yield self.count([t])[0] if n is None else next(heads) + n


def frequent_pieces(df: DataFrame, text: str, path: str) -> dict[str, int]:
    """Token counts of the most frequent pieces of all texts.

    Each task counts its own texts and nominates at most NOMINEES pieces; only those summaries are shuffled, never the
    pieces of the texts. What is chosen changes the speed and no result.
    """

    def nominate(batches):
        seen: Counter = Counter()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(t.split(" ")[1:])
            if len(seen) > 40 * NOMINEES:
                seen = Counter(dict(seen.most_common(20 * NOMINEES)))
        top = [(w, n) for w, n in seen.most_common(NOMINEES) if n > 1 and w and len(w) <= LONG_WORD and plain(w)]
        yield pa.RecordBatch.from_pydict({"w": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    top = (
        df.select(F.col(text).alias("t"))
        .mapInArrow(nominate, "w string, n long")
        .groupBy("w")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "w")
        .limit(FREQUENT)
    )
    words = sorted(r["w"] for r in top.collect())  # FREQUENT short strings at most
    if not words:
        return {}
    return dict(zip(words, TokenCounts(path).count([" " + w for w in words]), strict=True))


def count_tokens(df: DataFrame, id: str = "doc_id", text: str = "text", limit: int = 1024, path: str | None = None) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each row of ``df``.

    Two tiers, both on the map side: a broadcast table of the frequent pieces (FREQUENT entries at most), then the
    worker's own cache, which encodes misses in batches. Null and empty texts have 0 tokens; repeated rows stay.
    """
    path = path or default_path("byte_bpe_50k.json")
    table = small_batches(df).sparkSession.sparkContext.broadcast(frequent_pieces(df, text, path))
    kind = df.schema[id].dataType.simpleString()
    token = uuid.uuid4().int

    def count(batches):
        counts = worker(TokenCounts, path, token, table)
        for b in slices(batches, cached=True):
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = list(counts(texts))
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(id).alias("id"), F.col(text).alias("t")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id)
