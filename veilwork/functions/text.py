"""Column expressions: labels, proofs, counts, entropy, spans."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def norm_label(label: Column) -> Column:
    """Lower case without spaces, dashes and underscores."""
    return F.translate(F.lower(label), " -_", "")


def short_label(label: Column) -> Column:
    """Display name: looked up as is, then with separators as spaces, then without parentheses; else words in title case."""
    names = _map(K.RAW_TO_DISPLAY)
    words = F.filter(F.split(F.translate(label, "-_", "  "), r"\s+"), lambda w: w != "")
    spaced = F.array_join(F.transform(words, F.lower), " ")
    cased = F.transform(
        words,
        lambda w: F.when(F.lower(w).isin(K.UPPER_WORDS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))),
    )
    return F.coalesce(
        F.try_element_at(names, F.lower(label)),
        F.try_element_at(names, spaced),
        F.try_element_at(names, F.translate(spaced, "()", "")),
        F.array_join(cased, " "),
    )


def is_low_signal(label: Column) -> Column:
    return label.isin(K.LOW_SIGNAL)


def is_high_precision(label: Column) -> Column:
    wanted = sorted({re.sub("[ _-]", "", x.lower()) for x in K.HIGH_PRECISION})
    return norm_label(label).isin(wanted)


def secret_hash(secret: Column) -> Column:
    return F.sha2(secret, 256)


def proof(secret: Column, label: Column) -> Column:
    """``Type · head…tail · #hash``: enough to recognise a secret by, never the secret. The hash is of the unstripped value."""
    s = F.regexp_replace(secret, r"^\s+|\s+$", "")
    n = F.length(s)
    head = F.when(n >= 40, 6).when(n >= 20, 4).when(n >= 12, 3).otherwise(2)
    tail = F.when(n >= 40, 4).when(n >= 20, 2).otherwise(1)
    preview = F.regexp_replace(F.concat(F.substr(s, F.lit(1), head), F.lit("…"), F.right(s, tail)), r"\p{C}", "·")
    mark = F.concat(F.lit("#"), F.substring(secret_hash(secret), 1, 8))
    return F.concat_ws(" · ", short_label(label), F.when(n >= 8, preview), mark)


def pii_proof(value: Column, label: Column) -> Column:
    return F.concat(label, F.lit(" · #"), F.substring(F.sha2(value, 256), 1, 8))


def split_proof(text: Column) -> Column:
    """Proof to (kind, preview or a dash, hash)."""
    parts = F.split(text, " · ")
    return F.struct(
        parts[0].alias("kind"),
        F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), " · ")).otherwise("—").alias("preview"),
        F.when(F.size(parts) >= 2, F.element_at(parts, -1)).otherwise("").alias("hash"),
    )


def short_path(path: Column, most: int = 48) -> Column:
    """At most about ``most`` characters of a path: its first part and the end of its last, or the end of a bare name."""
    head, tail = F.split_part(path, F.lit("/"), F.lit(1)), F.split_part(path, F.lit("/"), F.lit(-1))
    room = F.greatest(F.lit(12), F.lit(most - 3) - F.length(head))
    end = F.when(F.length(head) + F.length(tail) + 3 <= most, tail).otherwise(F.right(tail, room))
    cut = F.when(F.contains(path, F.lit("/")), F.concat(head, F.lit("/…/"), end)).otherwise(F.concat(F.lit("…"), F.right(path, F.lit(max(8, most - 1)))))
    return F.when(F.length(path) <= most, path).otherwise(cut)


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs without overlap."""
    return F.when(part == "", 0).otherwise((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def good_secret(secret: Column) -> Column:
    """Eight characters at least, not all white space."""
    return (F.length(secret) >= 8) & ~F.rlike(secret, F.lit(r"^\s+$"))


def literal_start(pattern: str) -> str:
    """The characters that every match of ``pattern`` starts with, as far as they are plain in it."""
    out = re.match(r"(?:[A-Za-z0-9_:/ -]|\\[.])*(?![{*?])", pattern)[0]
    return out.replace("\\", "")


def vendor_label(secret: Column) -> Column:
    """Label of the first vendor shape that a match of the bank fits as a whole; a shape is only asked if its plain start is there."""
    out = F.lit("unknown")
    for label, pattern in reversed(K.VENDOR):
        fits = F.rlike(secret, F.lit(f"^(?:{pattern})$"))
        start = literal_start(pattern)
        out = F.when(F.startswith(secret, F.lit(start)) & fits if start else fits, label).otherwise(out)
    return out


def title_label(name: Column) -> Column:
    """A raw detector label for a chart: words in title case, known short forms in upper case; names that are shown already stay."""
    words = F.filter(F.split(F.translate(name, "-_", "  "), r"\s+"), lambda w: w != "")
    cased = F.transform(
        words, lambda w: F.when(F.lower(w).isin(K.CHART_UPPER_WORDS), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    )
    shown = (name != F.lower(name)) & ~F.contains(name, F.lit("-")) & ~F.contains(name, F.lit("_"))
    return F.when(shown, name).otherwise(F.array_join(cased, " "))


def escape_markup(text: Column) -> Column:
    """Text that a terminal shows as it is: opening brackets of what would be read as tags get a backslash."""
    return F.regexp_replace(text, r"(\\*)(\[[a-z#/@][^\[]*?\])", r"$1$1\\$2")


# Short texts ---------------------------------------------------------------------------------------------------------


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def is_short(text: Column) -> Column:
    return (F.length(text) <= K.SHORT_TEXT_CHARS) & (newlines(text) < K.SHORT_TEXT_LINES)


def has_marker(text: Column) -> Column:
    """Plain substring tests, which are far cheaper than one alternation of the markers; the text is computed once for all of them."""

    def any_of(t: Column) -> Column:
        out = F.contains(t, F.lit(K.MARKERS[0]))
        for m in K.MARKERS[1:]:
            out = out | F.contains(t, F.lit(m))
        return out

    return let(text, any_of)


def may_hold_token(text: Column) -> Column:
    """False only where no vendor shape can match: all but one begin with a marker."""
    return let(text, lambda t: has_marker(t) | F.rlike(t, F.lit("[0-9]{8}:")))


def searched(text: Column) -> Column:
    """Short enough to search at once, or holding a marker."""
    return (F.length(text) <= K.DIRECT_REGEX_CHARS) | has_marker(text)


# Entropy -------------------------------------------------------------------------------------------------------------


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters in bits."""
    chars = F.split(value, "")
    n = F.length(value).cast("double")
    share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def looks_random(value: Column) -> Column:
    kinds = F.size(F.array_distinct(F.split(value, "")))
    n = F.length(value)
    return (n >= K.ENTROPY_CHARS) & (kinds >= K.ENTROPY_DISTINCT) & (kinds / n >= K.ENTROPY_SHARE) & (entropy(value) >= K.ENTROPY_BITS)


# Spans ---------------------------------------------------------------------------------------------------------------

_OPEN, _CLOSE = "\x01", "\x02"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def find_spans(text: Column, pattern: str) -> Column:
    """All matches as an array of (start, end), in code points, ends exclusive."""
    clean = F.translate(text, _OPEN + _CLOSE, "\x03\x03")
    marked = F.regexp_replace(clean, f"({pattern})", f"{_OPEN}$1{_CLOSE}")

    def add(s, p):
        end = s["at"] + F.instr(p, _CLOSE) - 1
        return F.struct((s["at"] + F.length(p) - 1).alias("at"), F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), end.alias("end")))).alias("spans"))

    def walk(pieces):
        # Before piece i lie the pieces up to it, less one closing mark for each but the first.
        start = F.struct(F.length(pieces[0]).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
        return F.aggregate(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), start, add)["spans"]

    return let(F.split(marked, _OPEN), walk)


#: What a text must hold for a rule to match: a test that costs little beside the rule.
_GATES = {
    "EMAIL": lambda t: F.contains(t, F.lit("@")),
    "URL": lambda t: F.contains(t, F.lit("://")),
    "IP_ADDRESS": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
    "SSN": lambda t: F.rlike(t, F.lit("[0-9]{3}[^0-9][0-9]{2}[^0-9]")),
    "CREDIT_CARD": lambda t: F.rlike(t, F.lit("[0-9][ -]*[0-9][ -]*[0-9]")),
}


def gated(text: Column, label: str, found: Column, empty: str) -> Column:
    return F.when(_GATES[label](text), found).otherwise(F.array().cast(empty))


def trim_url(value: Column) -> Column:
    """Without closing signs, then without closing parentheses that nothing opens."""
    v = F.regexp_replace(value, r"[.,;:!?\]]+$", "")
    count = lambda sign: F.length(v) - F.length(F.replace(v, F.lit(sign), F.lit("")))
    run = F.length(F.regexp_extract(v, r"\)*$", 0))
    drop = F.least(run, F.greatest(F.lit(0), count(")") - count("(")))
    return F.substr(v, F.lit(1), F.length(v) - drop)


def good_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)


def good_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def pii_values(text: Column, label: str) -> Column:
    """Values of one rule, as an array of text."""
    found = gated(text, label, F.regexp_extract_all(text, F.lit(K.PII[label]), F.lit(0)), "array<string>")
    if label == "URL":
        return F.transform(found, trim_url)
    if label == "IP_ADDRESS":
        return F.filter(found, good_ip)
    if label == "CREDIT_CARD":
        return F.filter(found, good_card)
    return found
