"""Queries op4, op5 and op10 and the SQL that holds for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, mixing, url_filter
from ._util import table

URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

PROBE = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(probe).select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    back = chat_format.read_back(chat_format.format_chats(rows))
    loss = F.array_join(F.transform("turns", lambda t: t["loss"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) AS body,
    CASE WHEN role IN ('user', 'assistant', 'system', 'tool') THEN length(role)
         ELSE 1 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) END AS head
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + head + 2 + body + 9) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


OP5_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(action, text, h, s) AS (VALUES
  ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')
), best AS (
  SELECT page_id, host, path, max_by(r.text, length(r.text)) AS rule, max_by(r.action, length(r.text)) AS action
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN regexp_matches(host || path, '/(casino|poker|betting|slots|roulette|porn|xxx|escort|camgirls|viagra|cialis|pharmacy-online|warez|torrent|crack|keygen|serials|phishing|malware|adserver|adclick|banner-ads|cgi-bin|wp-admin|payday-loans)/|\.(exe|msi|apk|dmg|iso|rar|torrent)$') THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


QUERIES = {"op4_chat_format": op4_chat_format, "op5_url_filter": op5_url_filter, "op10_mixing": op10_mixing}
ORACLES = {"op4_chat_format": OP4_SQL, "op5_url_filter": OP5_SQL}
