"""Detection: vendor tokens, high-entropy strings and personal data."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import text as X

SPANS = "array<struct<start:int,end:int,label:string,rule:int,score:double>>"


def exploded(df: DataFrame, keep: tuple[str, ...], values: Column, name: str) -> DataFrame:
    """Rows (*keep, name), one a value. The outer form, as the inner one makes the planner compute the values a second time, to filter by their number."""
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def vendor_matches(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Rows (*keep, secret, label), one a match. The bank is one expression, so a text is searched once."""
    # The gate stands inside the value, so that the text is computed once, whatever expression it is.
    values = X.let(F.col(text), lambda t: F.when(X.may_hold_token(t), F.regexp_extract_all(t, F.lit(K.VENDOR_ANY), F.lit(0))))
    found = exploded(df, keep, values, "secret")
    return found.withColumn("label", X.vendor_label(F.col("secret")))


def entropy_candidates(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Rows (*keep, value): long token-like strings, before the test of their entropy."""
    return exploded(df, keep, F.regexp_extract_all(F.col(text), F.lit(K.ENTROPY_CANDIDATE), F.lit(0)), "value")


def pii_matches(df: DataFrame, *keep: str, text: str = "text", labels: list[str] | None = None) -> DataFrame:
    """Rows (*keep, label, value), one a match of a rule."""

    def of(t: Column, label: str) -> Column:
        return F.transform(X.pii_values(t, label), lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))

    rules = X.let(F.col(text), lambda t: F.flatten(F.array(*[of(t, n) for n in labels or K.PII])))
    return exploded(df, keep, rules, "m").select(*keep, "m.label", "m.value")


def detections(*sources: DataFrame) -> DataFrame:
    """One row a secret from rows (secret, raw_label, detector, priority): the label of the detector with the smallest priority."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    rows = rows.where(X.good_secret(F.col("secret")))
    return rows.groupBy("secret").agg(
        F.min_by("raw_label", F.struct("priority", "raw_label")).alias("raw_label"), F.sort_array(F.collect_set("detector")).alias("detectors")
    )


# Spans ---------------------------------------------------------------------------------------------------------------


def pii_spans(text: Column) -> Column:
    """Spans of all rules in one array; ``rule`` is the rule's place."""
    value = lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"])

    def of(rule: int, label: str, pattern: str) -> Column:
        spans = X.gated(text, label, X.find_spans(text, pattern), "array<struct<start:int,end:int>>")
        if label == "URL":
            spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(X.trim_url(value(s)))).alias("end")))
        elif label == "IP_ADDRESS":
            spans = F.filter(spans, lambda s: X.good_ip(value(s)))
        elif label == "CREDIT_CARD":
            spans = F.filter(spans, lambda s: X.good_card(value(s)))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(label).alias("label"), F.lit(rule).alias("rule"), F.lit(1.0).alias("score")))

    return F.flatten(F.array(*[of(i, *x) for i, x in enumerate(K.PII.items())])).cast(SPANS)


def resolve(spans: Column) -> Column:
    """Greedy choice by start, then length, then score: a span is kept if it begins at or after the end of the last one kept."""
    before = lambda a, b: (
        F.when(a["start"] != b["start"], a["start"] - b["start"])
        .when(a["end"] != b["end"], b["end"] - a["end"])
        .when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1))
        .otherwise(a["rule"] - b["rule"])
    )
    start = F.struct(F.lit(-1).alias("last"), F.array().cast(SPANS).alias("kept"))

    def take(s, x):
        fits = x["start"] >= s["last"]
        return F.struct(F.when(fits, x["end"]).otherwise(s["last"]).alias("last"), F.when(fits, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(F.array_sort(spans, before), start, take)["kept"]


def merge_model(rule_spans: Column, model_spans: Column) -> Column:
    """Rule spans and those model spans of known labels that overlap none of them, resolved; labels to keep are left alone."""
    known = F.filter(model_spans, lambda m: m["label"].isin(K.MODEL_LABELS) & ~m["label"].isin(K.KEEP_LABELS))
    apart = F.filter(known, lambda m: ~F.exists(rule_spans, lambda d: (d["start"] < m["end"]) & (d["end"] > m["start"])))
    return resolve(F.concat(rule_spans, apart.cast(SPANS)))


def _plain(c: str) -> str:
    return c.lower() if c < "\x80" else "".join(d for d in unicodedata.normalize("NFKD", c.lower()) if unicodedata.category(d) != "Mn")


def fold(text: str) -> str:
    """Lower case without accents."""
    return text.lower() if text.isascii() else "".join(map(_plain, text))


def normalized(text: str) -> tuple[str, list[int]]:
    """Lower case without accents, and for each character of it the place in ``text`` that it comes from."""
    if text.isascii():
        return text.lower(), list(range(len(text)))
    out, places = [], []
    for i, c in enumerate(text):
        piece = _plain(c)
        out.append(piece)
        places += [i] * len(piece)
    return "".join(out), places


def original_place(at: int, places: list[int], length: int) -> int:
    """The place in the text of ``length`` characters that a place in its normalized form stands for; beyond its ends, the ends."""
    return 0 if at <= 0 else length if at >= len(places) else places[at]


def model_spans(
    df: DataFrame,
    model: Callable[[list[str]], list[list[tuple[str, int, int, float]]]],
    text: str = "text",
    chunk: int = 100_000,
    overlap: int = 4096,
    min_score: float = K.MIN_SCORE,
    batch: int = 64,
    normalize_first: bool = True,
) -> DataFrame:
    """``df`` with ``model_spans`` from an injected recogniser, which runs over overlapping chunks of the texts in Arrow batches.

    ``model`` gets ``batch`` texts at a time and gives (label, start, end, score) for each, in places of what it was given: the
    normalized chunk, unless ``normalize_first`` is false. Places are mapped back to the text. Windows of tokens inside a chunk are
    the model's own affair, see ``windows``. Spans under the least score are dropped, those found twice in an overlap count once,
    with their best score.
    """

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        parts = []  # (row, where the chunk starts, what the model sees, places, length)
        for row, t in enumerate(texts):
            t = t or ""
            for at in range(0, max(1, len(t) - overlap), chunk - overlap) if len(t) > chunk else [0]:
                piece = t[at : at + chunk]
                shown, places = normalized(piece) if normalize_first else (piece, list(range(len(piece))))
                parts.append((row, at, shown, places, len(piece)))
        best: list[dict] = [{} for _ in texts]
        for a in range(0, len(parts), batch):
            some = parts[a : a + batch]
            for (row, at, _, places, n), spans in zip(some, model([p[2] for p in some]), strict=True):
                for label, start, end, score in spans:
                    if score >= min_score and end > start:
                        key = (at + original_place(start, places, n), at + original_place(end, places, n), label)
                        best[row][key] = max(score, best[row].get(key, score))
        return pd.Series([[{"start": s, "end": e, "label": n, "rule": len(K.PII), "score": float(x)} for (s, e, n), x in sorted(found.items())] for found in best])

    return df.withColumn("model_spans", find(F.col(text)))


def windows(n: int, most: int = 510, stride: int = 64) -> list[tuple[int, int]]:
    """Overlapping runs of at most ``most`` of ``n`` tokens: each but the first repeats ``stride`` tokens of the one before."""
    out = [(0, min(n, most))]
    while out[-1][1] < n:
        start = out[-1][1] - stride
        out.append((start, min(n, start + most)))
    return out


def bio_decode(tokens: DataFrame, *keys: str, order: str = "pos", tag: str = "tag", score: str = "score", min_score: float = K.MIN_SCORE) -> DataFrame:
    """Spans (label, first, last, score) from tagged tokens: B- opens, I- of the same label goes on, weak or other tags close."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    label = F.when((F.col(score) >= min_score) & F.rlike(tag, F.lit("^[BI]-")), F.substr(F.col(tag), F.lit(3)))
    rows = tokens.withColumn("label", label)
    before = F.lag("label").over(w)
    opens = F.col("label").isNotNull() & (F.startswith(tag, F.lit("B-")) | before.isNull() | (before != F.col("label")))
    rows = rows.withColumn("_opens", opens.cast("int"))
    rows = rows.withColumn("span", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("label is not null")
    return rows.groupBy(*keys, "span", "label").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.avg(score).alias("score"))


_NORMALIZED = T.StructType([T.StructField("text", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])
#: Texts that are Python objects at once.
_ROWS = 256


def _in_pieces(texts: pa.Array, make, kind: pa.DataType) -> pa.Array:
    """What ``make`` gives for each text, a few texts at a time."""
    parts = [pa.array([make(t) for t in texts.slice(at, _ROWS).to_pylist()], kind) for at in range(0, len(texts), _ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@F.arrow_udf(_NORMALIZED)
def normalize(texts: pa.Array) -> pa.Array:
    """Lower case without accents, and for each character the place it comes from."""
    kind = pa.struct([("text", pa.string()), ("offsets", pa.list_(pa.int32()))])
    return _in_pieces(texts, lambda t: dict(zip(("text", "offsets"), normalized(t or ""), strict=True)), kind)


@F.arrow_udf(T.StringType())
def folded(texts: pa.Array) -> pa.Array:
    """Lower case without accents; the places, many times the size of the text, are not made."""
    return _in_pieces(texts, lambda t: t if t is None else fold(t), pa.string())
