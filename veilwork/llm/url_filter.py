r"""URL filter: pattern rules indexed by their rarest literal token.

A rule is compiled to one regular expression over ``host + path``. Of the literal tokens that every match must hold as whole tokens,
the one that occurs in the fewest URLs of the table indexes the rule. A URL's own tokens fetch the candidate rules and only these run
their expressions, so cost follows the hits and not the length of the rule list. Two forms of the same index, with the same results:

* up to INLINE rules stand in the plan, each with its expression as a constant behind the test for its token. No row moves but the
  small count of rule tokens;
* longer lists, of any length, are a table (token, expression) that is joined to the tokens of the distinct URLs; Spark broadcasts
  it if it is small and shuffles it if not. Rules without a token of their own are fetched by every URL. Rows are joined to the
  verdicts of their URLs, so select the columns that are needed first.

Everything is DataFrame functions, no Python runs on rows.

Cases: a null URL, or one without ``://``, has empty host and path, which no host rule fits; very long URLs are matched whole. Empty
table: no rows. Ties between rules of equal length go to block before allow, then to the smaller text. Repeated rows each get a
verdict. Columns of the input that clash with ``host``, ``path``, ``rule`` or ``verdict`` are replaced; others may have any names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import ascii_lower

#: Rules that stand in the plan; longer lists are joined.
INLINE = 256

SPLIT = "[^A-Za-z0-9]+"

#: The method's own patterns, asked when no host rule fits. ``*`` stands for anything.
_FOLDERS = [
    "casino", "poker", "betting", "slots", "roulette", "porn", "xxx", "escort", "camgirls", "viagra", "cialis", "pharmacy-online", "warez",
    "torrent", "crack", "keygen", "serials", "phishing", "malware", "adserver", "adclick", "banner-ads", "cgi-bin", "wp-admin", "payday-loans",
]
_FILES = ["exe", "msi", "apk", "dmg", "iso", "rar", "torrent"]
DEFAULT_PATTERNS = [*(("block", f"*/{x}/*") for x in _FOLDERS), *(("block", f"*.{x}") for x in _FILES)]


@dataclass(frozen=True)
class Rule:
    action: str
    text: str
    regex: str
    tokens: tuple[str, ...]
    rank: int  # 0: host rules, 1: patterns


def host_rule(action: str, text: str) -> Rule:
    """``host/path``: fits the host, its subdomains, and paths that start with the rule's."""
    host, slash, path = text.partition("/")
    literal = host + slash + path
    # The last token is whole only if a separator of the rule closes it; the first one starts at a label.
    whole = [m[0] for m in re.finditer("[A-Za-z0-9]+", literal) if m.end() < len(literal) or not slash]
    end = "" if slash else "(?:/|$)"
    return Rule(action, text, r"^(?:[^/]*\.)?" + re.escape(literal) + end, tuple(whole), 0)


def pattern_rule(action: str, text: str) -> Rule:
    """``*`` matches anything, the rest literally, anywhere in ``host + path`` unless the pattern is closed at an end."""
    body = text.strip("*")
    left, right = "" if text.startswith("*") else "^", "" if text.endswith("*") else "$"
    regex = left + ".*".join(map(re.escape, body.split("*"))) + right
    whole = []
    for m in re.finditer("[A-Za-z0-9]+", body):
        before = body[m.start() - 1] if m.start() else ("" if left else "*")
        after = body[m.end()] if m.end() < len(body) else ("" if right else "*")
        if "*" not in (before, after):
            whole.append(m[0])
    return Rule(action, text, "(?s)" + regex, tuple(whole), 1)


def host_and_path(url):
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def compile_rules(rules: list[tuple[str, str]], patterns: list[tuple[str, str]]) -> list[Rule]:
    """All rules in the order in which they win."""
    return sorted({host_rule(*r) for r in rules} | {pattern_rule(*p) for p in patterns}, key=lambda r: (r.rank, -len(r.text), r.action != "block", r.text))


def url_tokens() -> Column:
    return F.array_distinct(F.split(F.concat("host", "path"), SPLIT))


def rarest(urls: DataFrame, compiled: list[Rule]) -> list[str | None]:
    """For each rule its token that the fewest of ``urls`` (host, path) hold; None if it has none."""
    literals = sorted({t for r in compiled for t in r.tokens})
    seen = {}
    if literals:
        table = urls.sparkSession.createDataFrame(pa.table({"token": pa.array(literals, pa.string())}))
        found = urls.select(F.explode(url_tokens()).alias("token")).groupBy("token").count().join(table, "token", "left_semi")
        seen = {r["token"]: r["count"] for r in found.collect()}  # a row for each token of the rules at most
    return [min(r.tokens, key=lambda t: (seen.get(t, 0), -len(t), t)) if r.tokens else None for r in compiled]


def _inline(urls: DataFrame, compiled: list[Rule], index: list[str | None]) -> DataFrame:
    """``urls`` with ``best``: the first rule, in order, whose token is there and whose expression matches."""
    text = F.concat("host", "path")

    def first(tokens: Column) -> Column:
        tests = []
        for i, (r, token) in enumerate(zip(compiled, index, strict=True)):
            fits = F.rlike(text, F.lit(r.regex))
            tests.append(F.when(F.array_contains(tokens, token) & fits if token is not None else fits, F.lit(i)))
        return F.coalesce(*tests)

    return urls.withColumn("tokens", url_tokens()).withColumn("best", first(F.col("tokens"))).drop("tokens")


def _joined(urls: DataFrame, compiled: list[Rule], index: list[str | None]) -> DataFrame:
    """The same for lists of any length. Every URL holds the token that is empty, which fetches the rules without one."""
    rules = pa.table({"best": pa.array(range(len(compiled)), pa.int32()), "token": pa.array([t or "" for t in index], pa.string()), "regex": pa.array([r.regex for r in compiled], pa.string())})
    rules = urls.sparkSession.createDataFrame(rules)
    own = urls.select("host", "path").distinct()
    fetched = own.select("host", "path", F.explode(F.array_union(url_tokens(), F.array(F.lit("")))).alias("token")).join(rules, "token")
    hits = fetched.where(F.rlike(F.concat("host", "path"), F.col("regex"))).groupBy("host", "path").agg(F.min("best").alias("best"))
    return urls.join(hits, ["host", "path"], "left")


def filter_urls(
    df: DataFrame,
    rules: list[tuple[str, str]],
    patterns: list[tuple[str, str]] = DEFAULT_PATTERNS,
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (of the host rules; else null) and ``verdict`` to every row of ``df``."""
    new = ("host", "path", "rule", "verdict")
    compiled = compile_rules(rules, patterns)
    host, path = host_and_path(F.col(url))
    # The row as one value, so that no name of its columns can clash.
    kept = [F.col(f"`{c}`") for c in df.columns if c not in new]
    urls = df.select(F.struct(*kept).alias("row") if kept else F.lit(None).alias("row"), host.alias("host"), path.alias("path"))
    if not compiled:
        judged = urls.withColumn("best", F.lit(None).cast("int"))
    elif len(compiled) <= INLINE:
        judged = _inline(urls, compiled, rarest(urls, compiled))
    else:
        judged = _joined(urls, compiled, rarest(urls, compiled))
    if len(compiled) <= INLINE:
        names = F.array(*[F.lit(r.text if r.rank == 0 else None).cast("string") for r in compiled]) if compiled else F.array(F.lit(None).cast("string"))
        actions = F.array(*[F.lit(r.action) for r in compiled]) if compiled else F.array(F.lit(default))
        judged = judged.withColumns({"rule": F.get(names, F.col("best")), "verdict": F.coalesce(F.get(actions, F.col("best")), F.lit(default))})
    else:
        named = pa.table({"best": pa.array(range(len(compiled)), pa.int32()), "rule": pa.array([r.text if r.rank == 0 else None for r in compiled], pa.string()), "verdict": pa.array([r.action for r in compiled], pa.string())})
        judged = judged.join(df.sparkSession.createDataFrame(named), "best", "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return judged.select(*(["row.*"] if kept else []), *new)
