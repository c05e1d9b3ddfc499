"""Pieces of the DuckDB SQL that the queries are held against."""

from __future__ import annotations

import re

from ..functions import constants as K
from ..sources.tables import PLANTED_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], *names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else q(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({', '.join(names)}))"


def in_list(xs) -> str:
    return "(" + ", ".join(map(q, xs)) + ")"


def short_label(x: str) -> str:
    names = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in K.RAW_TO_DISPLAY.items()) + "}"
    words = f"list_filter(string_split_regex(translate({x}, '-_', '  '), '\\s+'), lambda w: w <> '')"
    spaced = f"array_to_string(list_transform({words}, lambda w: lower(w)), ' ')"
    cased = (
        f"array_to_string(list_transform({words}, lambda w: CASE WHEN lower(w) IN {in_list(K.UPPER_WORDS)} THEN upper(w) "
        "ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ')"
    )
    return f"coalesce(({names})[lower({x})], ({names})[{spaced}], ({names})[translate({spaced}, '()', '')], {cased})"


def title_label(x: str) -> str:
    words = f"list_filter(string_split_regex(translate({x}, '-_', '  '), '\\s+'), lambda w: w <> '')"
    cased = f"array_to_string(list_transform({words}, lambda w: CASE WHEN lower(w) IN {in_list(K.CHART_UPPER_WORDS)} THEN upper(w) ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ')"
    return f"CASE WHEN {x} <> lower({x}) AND NOT contains({x}, '-') AND NOT contains({x}, '_') THEN {x} ELSE {cased} END"


def norm_label(x: str) -> str:
    return f"translate(lower({x}), ' -_', '')"


def high_precision(x: str) -> str:
    return f"({norm_label(x)} IN {in_list(sorted({re.sub('[ _-]', '', v.lower()) for v in K.HIGH_PRECISION}))})"


def proof(s: str, label: str) -> str:
    t = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    n = f"length({t})"
    return (
        f"{short_label(label)} || ' · ' || CASE WHEN {n} >= 8 THEN substr({t}, 1, CASE WHEN {n} >= 40 THEN 6 WHEN {n} >= 20 THEN 4 WHEN {n} >= 12 THEN 3 ELSE 2 END) "
        f"|| '…' || right({t}, CASE WHEN {n} >= 40 THEN 4 WHEN {n} >= 20 THEN 2 ELSE 1 END) || ' · ' ELSE '' END || '#' || substr(sha256({s}), 1, 8)"
    )


VENDOR_LABEL = "CASE " + " ".join(f"WHEN regexp_full_match(secret, {q(p)}) THEN {q(n)}" for n, p in K.VENDOR) + " ELSE 'unknown' END"

#: planted, then every vendor match in it.
MATCHES = f"""WITH {PLANTED_SQL},
matches AS (
  SELECT *, {VENDOR_LABEL} AS label
  FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, {q(K.VENDOR_ANY)})) AS secret FROM planted)
)"""

#: The different secrets and in which documents they occur how often.
FINDINGS = f"""{MATCHES},
secrets AS (SELECT secret, min(label) AS label FROM matches WHERE length(secret) >= 8 AND NOT regexp_matches(secret, '^\\s+$') GROUP BY secret),
found AS (
  SELECT doc_id, source, secret, label AS raw_label, CAST((length(text) - length(replace(text, secret, ''))) // length(secret) AS BIGINT) AS hits
  FROM planted JOIN secrets ON contains(text, secret)
),
findings AS (
  SELECT doc_id, source, {short_label('raw_label')} AS type, {proof('secret', 'raw_label')} AS proof, sha256(secret) AS secret_hash, hits,
    {high_precision(short_label('raw_label'))} AS redactable, {short_label('raw_label')} IN {in_list(K.LOW_SIGNAL)} AS low_signal
  FROM found
)"""

SHORT = f"length(text) <= {K.SHORT_TEXT_CHARS} AND length(text) - length(replace(text, chr(10), '')) < {K.SHORT_TEXT_LINES}"
MARKER = f"regexp_matches(text, {q('|'.join(re.escape(m) for m in K.MARKERS).replace('\\-', '-'))})"
SEARCHED = f"(length(text) <= {K.DIRECT_REGEX_CHARS} OR {MARKER})"


def luhn(v: str) -> str:
    d = f"reverse(regexp_replace({v}, '[^0-9]', '', 'g'))"
    digit = f"CAST(substr({d}, CAST(i AS INTEGER), 1) AS INTEGER)"
    each = f"CASE WHEN i % 2 = 1 THEN {digit} ELSE 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END"
    return f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, CAST(length({d}) + 1 AS BIGINT)), lambda i: {each})) % 10 = 0)"


def trim_url(v: str) -> str:
    t = f"regexp_replace({v}, '[.,;:!?\\]]+$', '')"
    count = lambda sign: f"(length({t}) - length(replace({t}, '{sign}', '')))"
    drop = f"least(length(regexp_extract({t}, '\\)*$')), greatest(0, {count(')')} - {count('(')}))"
    return f"substr({t}, 1, length({t}) - {drop})"


def good_ip(v: str) -> str:
    return f"len(list_filter(string_split({v}, '.'), lambda o: CAST(o AS BIGINT) > 255)) = 0"


def pii_values(label: str, text: str = "text") -> str:
    found = f"regexp_extract_all({text}, {q(K.PII[label])})"
    if label == "URL":
        return f"list_transform({found}, lambda u: {trim_url('u')})"
    if label == "IP_ADDRESS":
        return f"list_filter({found}, lambda p: {good_ip('p')})"
    return found


def pii_matches(source: str, id: str, text: str = "text", labels=None) -> str:
    """A query of rows (id, label, value)."""
    parts = []
    for n in labels or K.PII:
        part = f"SELECT {id}, {q(n)} AS label, unnest({pii_values(n, text)}) AS value FROM {source}"
        parts.append(f"SELECT * FROM ({part}) WHERE {luhn('value')}" if n == "CREDIT_CARD" else part)
    return " UNION ALL ".join(parts)


def places(source: str, id: str, text: str, pattern: str) -> str:
    """A query of rows (id, s, v): the places and values of all matches."""
    marked = f"regexp_replace(translate({text}, chr(1) || chr(2), chr(3) || chr(3)), {q('(' + pattern + ')')}, chr(1) || '\\1' || chr(2), 'g')"
    pieces = f"SELECT {id}, {text} AS txt, unnest(string_split({marked}, chr(1))) AS p, generate_subscripts(string_split({marked}, chr(1)), 1) AS k FROM {source}"
    placed = f"SELECT *, CAST(coalesce(sum(length(replace(p, chr(2), ''))) OVER (PARTITION BY {id} ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM ({pieces})"
    return f"SELECT {id}, s, substr(txt, s + 1, instr(p, chr(2)) - 1) AS v FROM ({placed}) WHERE k > 1"


def spans(source: str, id: str, text: str = "text") -> str:
    """A query of rows (id, label, rule, s, e, v): the places of all matches, ends exclusive, before any is dropped for overlap."""
    parts = []
    for i, (n, p) in enumerate(K.PII.items()):
        valued = places(source, id, text, p)
        if n == "URL":
            valued = f"SELECT {id}, s, {trim_url('v')} AS v FROM ({valued})"
        elif n == "IP_ADDRESS":
            valued = f"SELECT * FROM ({valued}) WHERE {good_ip('v')}"
        elif n == "CREDIT_CARD":
            valued = f"SELECT * FROM ({valued}) WHERE {luhn('v')}"
        parts.append(f"SELECT {id}, {q(n)} AS label, {i} AS rule, s, s + length(v) AS e, v FROM ({valued})")
    return " UNION ALL ".join(parts)


def resolved(found: str) -> str:
    """Common table expressions up to resolved (doc_id, label, s, e, v): a chain over each document's spans in ``found``, in order."""
    return f"""spans AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, rule) AS k FROM ({found})),
chain AS (
  SELECT doc_id, label, s, e, v, k, e AS last, true AS kept FROM spans WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.label, n.s, n.e, n.v, n.k, CASE WHEN n.s >= c.last THEN n.e ELSE c.last END, n.s >= c.last
  FROM chain c JOIN spans n ON n.doc_id = c.doc_id AND n.k = c.k + 1
),
resolved AS (SELECT doc_id, label, s, e, v FROM chain WHERE kept)"""


#: Resolved spans of the planted corpus.
RESOLVED = f"WITH RECURSIVE {PLANTED_SQL}, {resolved(spans('planted', 'doc_id'))}"

#: Words that stand for what a recogniser of names finds, and the labels they get by their length.
NAMES = "[A-Z][a-z]{5,}"
_MODEL = f"SELECT doc_id, CASE length(v) % 3 WHEN 0 THEN 'GIVEN_NAME' WHEN 1 THEN 'CITY' ELSE 'PHONE' END AS label, 9 AS rule, s, s + length(v) AS e, v FROM ({places('planted', 'doc_id', 'text', NAMES)})"
#: Rule spans, and those model spans to redact that overlap none of them, resolved together.
MERGED = f"""WITH RECURSIVE {PLANTED_SQL}, rules AS ({spans('planted', 'doc_id')}),
apart AS (SELECT * FROM ({_MODEL}) m WHERE label NOT IN {in_list(K.KEEP_LABELS)} AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.doc_id = m.doc_id AND r.s < m.e AND r.e > m.s)),
{resolved("SELECT * FROM rules UNION ALL SELECT * FROM apart")}"""

RUN = "[A-Za-z0-9_@+/.-]+={0,2}"
#: What lies between such runs.
NO_RUN = "[^A-Za-z0-9_@+/.-]+"
CANDIDATE = "length(regexp_replace(v, '=+$', '')) >= 32 AND regexp_matches(v, '^[A-Za-z0-9].*[A-Za-z0-9]={0,2}$')"
CHARS = "string_split(v, '')"
SHARE = f"(len(list_filter({CHARS}, lambda d: d = c)) / CAST(length(v) AS DOUBLE))"
ENTROPY = f"list_sum(list_transform(list_distinct({CHARS}), lambda c: -{SHARE} * log2({SHARE})))"
RANDOM = f"(length(v) >= {K.ENTROPY_CHARS} AND len(list_distinct({CHARS})) >= {K.ENTROPY_DISTINCT} AND len(list_distinct({CHARS})) / CAST(length(v) AS DOUBLE) >= {K.ENTROPY_SHARE} AND {ENTROPY} >= {K.ENTROPY_BITS})"
