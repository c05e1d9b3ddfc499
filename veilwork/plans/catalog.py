"""Queries over the test tables by name, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import detect, findings, known, redact, state
from ..sources import files as trees
from ..sources import registry
from ..sources.shared import durable, new_path
from ..sources.tables import PLANTED_SQL, planted, table
from ..streaming import text as streams
from . import sql as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def long(c) -> F.Column:
    return c.cast("long")


# Personal data -------------------------------------------------------------------------------------------------------


def _pii_query(label: str):
    name = {"EMAIL": "email", "URL": "url", "IP_ADDRESS": "ip", "SSN": "ssn", "CREDIT_CARD": "card"}[label]

    @query(
        f"pii_{name}_findings",
        f"WITH {PLANTED_SQL}, m AS ({S.pii_matches('planted', 'doc_id', labels=[label])}) "
        "SELECT doc_id, label, label || ' · #' || substr(sha256(value), 1, 8) AS proof, sha256(value) AS value_hash, count(*) AS hits FROM m GROUP BY doc_id, label, value",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect.pii_matches(planted(spark, sf_dir), "doc_id", labels=[label]).groupBy("doc_id", "label", "value").agg(F.count(F.lit(1)).alias("hits"))
        return found.select("doc_id", "label", X.pii_proof(F.col("value"), F.col("label")).alias("proof"), F.sha2("value", 256).alias("value_hash"), "hits")


for _label in K.PII:
    _pii_query(_label)


def _pii_rollup(rows: DataFrame, id: str, text: str) -> DataFrame:
    found = detect.pii_matches(rows, id, text=text)
    return found.groupBy("label").agg(F.count_distinct(id).alias("files"), F.count(F.lit(1)).alias("hits"), F.count_distinct("value").alias("secrets"))


def _rollup_sql(source: str, id: str, text: str) -> str:
    return f"SELECT label, count(DISTINCT {id}) AS files, count(*) AS hits, count(DISTINCT value) AS secrets FROM ({S.pii_matches(source, id, text)}) GROUP BY label"


@query("pii_label_rollup", _rollup_sql("documents", "doc_id", "text"))
def pii_label_rollup(spark, sf_dir):
    return _pii_rollup(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("pii_pages_rollup", _rollup_sql("pages", "page_id", "html"))
def pii_pages_rollup(spark, sf_dir):
    return _pii_rollup(table(spark, sf_dir, "pages"), "page_id", "html")


def _resolved(spark, sf_dir) -> DataFrame:
    return planted(spark, sf_dir).withColumn("spans", X.let(F.col("text"), lambda t: detect.resolve(detect.pii_spans(t))))


@query("pii_spans_resolved", f'{S.RESOLVED} SELECT doc_id, label, s AS "start", e AS "end", sha256(v) AS value_hash FROM resolved')
def pii_spans_resolved(spark, sf_dir):
    rows = detect.exploded(_resolved(spark, sf_dir), ("doc_id", "text"), F.col("spans"), "s")
    value = F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return rows.select("doc_id", "s.label", long(F.col("s.start")).alias("start"), long(F.col("s.end")).alias("end"), F.sha2(value, 256).alias("value_hash"))


_NUMBERED = f"""{S.RESOLVED},
numbered AS (
  SELECT *, '[' || label || '_' || dense_rank() OVER (PARTITION BY doc_id, label ORDER BY m DESC) || ']' AS placeholder
  FROM (SELECT *, max(s) OVER (PARTITION BY doc_id, label, v) AS m FROM resolved)
)"""


@query("pii_placeholders", f'{_NUMBERED} SELECT doc_id, s AS "start", placeholder, sha256(v) AS value_hash FROM numbered')
def pii_placeholders(spark, sf_dir):
    rows = detect.exploded(_resolved(spark, sf_dir), ("doc_id",), redact.placeholders(F.col("spans"), F.col("text")), "p")
    return rows.select("doc_id", long(F.col("p.start")).alias("start"), "p.placeholder", F.sha2("p.value", 256).alias("value_hash"))


@query(
    "pii_redacted_text",
    f"""{_NUMBERED},
parts AS (
  SELECT n.doc_id, string_agg(substr(text, n.from_ + 1, n.s - n.from_) || placeholder, '' ORDER BY n.s) AS front, max(e) AS tail
  FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS from_ FROM numbered) n JOIN planted p ON p.doc_id = n.doc_id GROUP BY n.doc_id
)
SELECT p.doc_id, coalesce(front || substr(text, tail + 1), text) AS text FROM planted p LEFT JOIN parts ON parts.doc_id = p.doc_id""",
)
def pii_redacted_text(spark, sf_dir):
    rows = _resolved(spark, sf_dir).withColumn("p", redact.placeholders(F.col("spans"), F.col("text")))
    return rows.select("doc_id", redact.replace_spans(F.col("text"), F.col("p")).alias("text"))


@query("pii_model_merge", f'{S.MERGED} SELECT doc_id, label, s AS "start", e AS "end", sha256(v) AS value_hash FROM resolved')
def pii_model_merge(spark, sf_dir):
    """Rule spans and those of a recogniser, whose place capitalised words take: known labels that overlap no rule span, less those to keep."""

    def merged(t):
        labels = lambda n: F.when(n % 3 == 0, "GIVEN_NAME").when(n % 3 == 1, "CITY").otherwise("PHONE")
        names = F.transform(X.find_spans(t, S.NAMES), lambda s: F.struct(s["start"], s["end"], labels(s["end"] - s["start"]).alias("label"), F.lit(9).alias("rule"), F.lit(0.9).alias("score")))
        return X.let(detect.pii_spans(t), lambda rules: detect.merge_model(rules, names))

    rows = detect.exploded(planted(spark, sf_dir).withColumn("spans", X.let(F.col("text"), merged)), ("doc_id", "text"), F.col("spans"), "s")
    value = F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return rows.select("doc_id", "s.label", long(F.col("s.start")).alias("start"), long(F.col("s.end")).alias("end"), F.sha2(value, 256).alias("value_hash"))


@query("pii_exit_status", f"{S.RESOLVED} SELECT p.doc_id, count(r.s) AS spans, CASE WHEN count(r.s) > 0 THEN 2 ELSE 0 END AS status FROM planted p LEFT JOIN resolved r ON r.doc_id = p.doc_id GROUP BY p.doc_id")
def pii_exit_status(spark, sf_dir):
    """What a check of each text would end with: 2 if personal data was found."""
    rows = _resolved(spark, sf_dir).select("doc_id", F.size("spans").cast("long").alias("spans"))
    return rows.withColumn("status", F.when(F.col("spans") > 0, 2).otherwise(0))


@query("text_normalize", "SELECT conv_id, turn, strip_accents(lower(text)) AS text FROM conversations")
def text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", detect.folded("text").alias("text"))


_TOKENS_SQL = """tokens AS (
  SELECT user_id, event_id AS pos, CASE event_id % 7 WHEN 0 THEN 'B-GIVEN_NAME' WHEN 1 THEN 'I-GIVEN_NAME' WHEN 2 THEN 'I-SURNAME' WHEN 3 THEN 'B-SURNAME' WHEN 4 THEN 'O' WHEN 5 THEN 'I-PHONE' ELSE 'I-PHONE' END AS tag,
    (event_id * 37 % 100) / 100.0 AS score FROM events)"""


@query(
    "ner_bio_decode",
    f"""WITH {_TOKENS_SQL},
l AS (SELECT *, CASE WHEN score >= 0.4 AND tag <> 'O' THEN substr(tag, 3) END AS label FROM tokens),
o AS (SELECT *, label IS NOT NULL AND (starts_with(tag, 'B-') OR lag(label) OVER w IS NULL OR lag(label) OVER w <> label) AS opens FROM l WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
g AS (SELECT *, sum(CAST(opens AS BIGINT)) OVER (PARTITION BY user_id ORDER BY pos) AS span FROM o)
SELECT user_id, label, min(pos) AS "first", max(pos) AS "last", round(avg(CAST(score AS DOUBLE)), 6) AS score FROM g WHERE label IS NOT NULL GROUP BY user_id, span, label""",
)
def ner_bio_decode(spark, sf_dir):
    tags = F.array(*map(F.lit, ["B-GIVEN_NAME", "I-GIVEN_NAME", "I-SURNAME", "B-SURNAME", "O", "I-PHONE", "I-PHONE"]))
    tokens = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("pos"), F.element_at(tags, (F.col("event_id") % 7 + 1).cast("int")).alias("tag"), (F.col("event_id") * 37 % 100 / 100.0).alias("score")
    )
    return detect.bio_decode(tokens, "user_id").select("user_id", "label", "first", "last", F.round("score", 6).alias("score"))


# Vendor tokens and short texts ---------------------------------------------------------------------------------------


@query("vendor_token_matches", f"{S.MATCHES} SELECT doc_id, label, sha256(secret) AS secret_hash, count(*) AS hits FROM matches GROUP BY doc_id, label, secret")
def vendor_token_matches(spark, sf_dir):
    found = detect.vendor_matches(planted(spark, sf_dir), "doc_id").groupBy("doc_id", "label", "secret").agg(F.count(F.lit(1)).alias("hits"))
    return found.select("doc_id", "label", X.secret_hash(F.col("secret")).alias("secret_hash"), "hits")


@query("vendor_family_counts", f"{S.MATCHES} SELECT label, count(DISTINCT doc_id) AS files, count(*) AS hits FROM matches GROUP BY label")
def vendor_family_counts(spark, sf_dir):
    return detect.vendor_matches(planted(spark, sf_dir), "doc_id").groupBy("label").agg(F.count_distinct("doc_id").alias("files"), F.count(F.lit(1)).alias("hits"))


_ANY = S.q(K.VENDOR_ANY)
_SHORT_REDACT = f"""SELECT doc_id, CASE WHEN {S.SHORT} AND {S.SEARCHED} THEN regexp_replace(text, {_ANY}, '{K.REDACTED}', 'g') ELSE text END AS text,
  CAST(CASE WHEN {S.SHORT} AND {S.SEARCHED} THEN len(regexp_extract_all(text, {_ANY})) ELSE 0 END AS BIGINT) AS redactions FROM planted"""


@query("short_text_redact", f"WITH {PLANTED_SQL} {_SHORT_REDACT}")
def short_text_redact(spark, sf_dir):
    return redact.redact_short_text(planted(spark, sf_dir)).select("doc_id", "text", "redactions")


@query(
    "short_text_gate_counts",
    f"WITH {PLANTED_SQL} SELECT source, count(*) AS files, count(*) FILTER (WHERE {S.SHORT}) AS short, count(*) FILTER (WHERE {S.SHORT} AND {S.SEARCHED}) AS searched FROM planted GROUP BY source",
)
def short_text_gate_counts(spark, sf_dir):
    c = F.col("text")
    return planted(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.count_if(X.is_short(c)).alias("short"), F.count_if(X.is_short(c) & X.searched(c)).alias("searched"))


@query("marker_gate", f"WITH {PLANTED_SQL} SELECT doc_id, {S.MARKER} AS marked, {S.SEARCHED} AS searched FROM planted")
def marker_gate(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", X.has_marker(F.col("text")).alias("marked"), X.searched(F.col("text")).alias("searched"))


# Entropy -------------------------------------------------------------------------------------------------------------

_BARE = "regexp_replace(v, '=+$', '')"
_CAND = f"WITH {PLANTED_SQL}, c AS (SELECT doc_id, {_BARE} AS v FROM (SELECT doc_id, unnest(regexp_extract_all(text, {S.q(S.RUN)})) AS v FROM planted) WHERE {S.CANDIDATE})"


def _candidates(spark, sf_dir):
    rows = detect.entropy_candidates(planted(spark, sf_dir), "doc_id")
    return rows.withColumn("value", F.regexp_replace("value", "=+$", ""))


@query("entropy_candidates", f"{_CAND} SELECT doc_id, sha256(v) AS value_hash, CAST(length(v) AS BIGINT) AS n_chars, count(*) AS hits FROM c GROUP BY doc_id, v")
def entropy_candidates(spark, sf_dir):
    rows = _candidates(spark, sf_dir).groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("hits"))
    return rows.select("doc_id", F.sha2("value", 256).alias("value_hash"), long(F.length("value")).alias("n_chars"), "hits")


@query("entropy_scores", f"{_CAND} SELECT doc_id, sha256(v) AS value_hash, round({S.ENTROPY}, 6) AS bits, {S.RANDOM} AS random FROM c GROUP BY doc_id, v")
def entropy_scores(spark, sf_dir):
    rows = _candidates(spark, sf_dir).distinct()
    v = F.col("value")
    return rows.select("doc_id", F.sha2(v, 256).alias("value_hash"), F.round(X.entropy(v), 6).alias("bits"), X.looks_random(v).alias("random"))


@query(
    "entropy_redact",
    f"""WITH {PLANTED_SQL},
pieces AS (
  SELECT doc_id, k, v, {S.CANDIDATE} AND {S.RANDOM} AS hit
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, {S.q(S.RUN + '|' + S.NO_RUN)})) AS v, generate_subscripts(regexp_extract_all(text, {S.q(S.RUN + '|' + S.NO_RUN)}), 1) AS k FROM planted)
)
SELECT p.doc_id, sha256(CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(t, '') END) AS text_hash, CAST(coalesce(n, 0) AS BIGINT) AS redactions FROM planted p
LEFT JOIN (SELECT doc_id, string_agg(CASE WHEN hit THEN '{K.REDACTED}' ELSE v END, '' ORDER BY k) AS t, count(*) FILTER (WHERE hit) AS n FROM pieces GROUP BY doc_id) r ON r.doc_id = p.doc_id""",
)
def entropy_redact(spark, sf_dir):
    rows = planted(spark, sf_dir).withColumn("e", X.let(F.col("text"), redact.redact_entropy))
    return rows.select("doc_id", F.sha2("e.text", 256).alias("text_hash"), F.coalesce(long(F.col("e.count")), F.lit(0)).alias("redactions"))


# Secrets, labels, findings -------------------------------------------------------------------------------------------


def _vendor_secrets(spark, sf_dir) -> DataFrame:
    found = detect.vendor_matches(planted(spark, sf_dir), "doc_id").where(X.good_secret(F.col("secret")))
    return durable(found.groupBy("secret").agg(F.min("label").alias("raw_label")))  # used several times


def _findings(spark, sf_dir) -> DataFrame:
    # Id and source go through the match as one value, so nothing has to be joined back.
    docs, secrets = planted(spark, sf_dir).select(F.struct("doc_id", "source").alias("own"), "text"), _vendor_secrets(spark, sf_dir)
    hits = known.match_known(docs, secrets, "own").select("own.doc_id", "own.source", "secret", "hits")
    return findings.findings(findings.with_types(hits, secrets))


@query("secrets_distinct", f"{S.MATCHES} SELECT sha256(secret) AS secret_hash, min(label) AS label, count(*) AS hits, count(DISTINCT doc_id) AS files FROM matches GROUP BY secret")
def secrets_distinct(spark, sf_dir):
    rows = detect.vendor_matches(planted(spark, sf_dir), "doc_id").groupBy("secret")
    out = rows.agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("files"))
    return out.select(X.secret_hash(F.col("secret")).alias("secret_hash"), "label", "hits", "files")


@query(
    "secret_min_quality",
    f"{S.MATCHES} SELECT doc_id, n, length(s) >= 8 AND NOT regexp_matches(s, '^\\s+$') AS good FROM (SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN n % 2 = 0 THEN substr(secret, 1, n) ELSE repeat(' ', n) END AS s "
    "FROM (SELECT DISTINCT doc_id, secret FROM matches), (SELECT unnest([1, 6, 7, 8, 9, 40]) AS n))",
)
def secret_min_quality(spark, sf_dir):
    """Fronts of vendor tokens, and blanks, of lengths about the least."""
    rows = detect.vendor_matches(planted(spark, sf_dir), "doc_id").select("doc_id", "secret").distinct()
    rows = rows.withColumn("n", F.explode(F.array(*map(F.lit, (1, 6, 7, 8, 9, 40)))))
    cut = F.when(F.col("n") % 2 == 0, F.substr("secret", F.lit(1), F.col("n"))).otherwise(F.repeat(F.lit(" "), F.col("n")))
    return rows.select("doc_id", long(F.col("n")).alias("n"), X.good_secret(cut).alias("good"))


_RAW = [*K.RAW_TO_DISPLAY, *(x.upper() for x in list(K.RAW_TO_DISPLAY)[::2])]
_RAW += ["some_new-api token", "Npm-Token", "NPMTOKEN", "Uri", "metabase", "Metabase", "aws  access_token", "Json Web Token (Base64url Encoded)", "AI id checker"]
_RAW += K.HIGH_PRECISION + K.LOW_SIGNAL
_RAW_ROWS = [(i, x) for i, x in enumerate(_RAW)]


def _raw_labels(spark) -> DataFrame:
    return spark.createDataFrame(_RAW_ROWS, "id long, raw string")


@query("label_normalize", f"SELECT CAST(id AS BIGINT) AS id, {S.short_label('raw')} AS display, {S.norm_label('raw')} AS norm FROM {S.values(_RAW_ROWS, 'id', 'raw')}")
def label_normalize(spark, sf_dir):
    return _raw_labels(spark).select("id", X.short_label(F.col("raw")).alias("display"), X.norm_label(F.col("raw")).alias("norm"))


@query("label_precision", f"SELECT CAST(id AS BIGINT) AS id, {S.high_precision(S.short_label('raw'))} AS redactable FROM {S.values(_RAW_ROWS, 'id', 'raw')}")
def label_precision(spark, sf_dir):
    return _raw_labels(spark).select("id", X.is_high_precision(X.short_label(F.col("raw"))).alias("redactable"))


@query("label_low_signal", f"SELECT CAST(id AS BIGINT) AS id, raw IN {S.in_list(K.LOW_SIGNAL)} AS low_signal FROM {S.values(_RAW_ROWS, 'id', 'raw')}")
def label_low_signal(spark, sf_dir):
    return _raw_labels(spark).select("id", X.is_low_signal(F.col("raw")).alias("low_signal"))


@query("label_titles", f"SELECT CAST(id AS BIGINT) AS id, {S.title_label('raw')} AS title FROM {S.values(_RAW_ROWS, 'id', 'raw')}")
def label_titles(spark, sf_dir):
    return _raw_labels(spark).select("id", X.title_label(F.col("raw")).alias("title"))


_MARKED = [(i, x) for i, x in enumerate(["plain", "[red]x[/red]", "a [b c] d", "[1] [A] []", "\\\\[dim]", "[@x][#y]", "x[", "[bold", "é [italic on blue]ü[/]"])]


@query("markup_escaped", f"SELECT CAST(id AS BIGINT) AS id, regexp_replace(raw, '(\\\\*)(\\[[a-z#/@][^\\[]*?\\])', '\\1\\1\\\\\\2', 'g') AS shown FROM {S.values(_MARKED, 'id', 'raw')}")
def markup_escaped(spark, sf_dir):
    return spark.createDataFrame(_MARKED, "id long, raw string").select("id", X.escape_markup(F.col("raw")).alias("shown"))


@query("detector_union", f"""{S.MATCHES},
rows AS (
  SELECT secret, label AS raw_label, 'bank' AS detector, 1 AS priority FROM matches
  UNION ALL SELECT v, 'generic secret', 'entropy', 2 FROM (SELECT unnest(regexp_extract_all(text, {S.q(S.RUN)})) AS v FROM planted) WHERE {S.CANDIDATE}
)
SELECT sha256(secret) AS secret_hash, min_by(raw_label, (priority, raw_label)) AS raw_label, array_to_string(list_sort(list(DISTINCT detector)), ',') AS detectors
FROM rows WHERE length(secret) >= 8 AND NOT regexp_matches(secret, '^\\s+$') GROUP BY secret""")  # fmt: skip
def detector_union(spark, sf_dir):
    docs = planted(spark, sf_dir)
    bank = detect.vendor_matches(docs).select("secret", F.col("label").alias("raw_label"), F.lit("bank").alias("detector"), F.lit(1).alias("priority"))
    other = detect.entropy_candidates(docs).select(F.col("value").alias("secret"), F.lit("generic secret").alias("raw_label"), F.lit("entropy").alias("detector"), F.lit(2).alias("priority"))
    found = detect.detections(bank, other)
    return found.select(X.secret_hash(F.col("secret")).alias("secret_hash"), "raw_label", F.array_join("detectors", ",").alias("detectors"))


@query("detector_counts", f"""{S.MATCHES}, e AS (SELECT DISTINCT v FROM (SELECT unnest(regexp_extract_all(text, {S.q(S.RUN)})) AS v FROM planted) WHERE {S.CANDIDATE})
SELECT 'bank' AS detector, count(DISTINCT secret) AS secrets FROM matches UNION ALL SELECT 'entropy', count(*) FROM e""")  # fmt: skip
def detector_counts(spark, sf_dir):
    docs = planted(spark, sf_dir)
    bank = detect.vendor_matches(docs).select(F.lit("bank").alias("detector"), "secret")
    other = detect.entropy_candidates(docs).select(F.lit("entropy").alias("detector"), F.col("value").alias("secret"))
    return bank.unionByName(other).groupBy("detector").agg(F.count_distinct("secret").alias("secrets"))


@query("findings_hits", f"{S.FINDINGS} SELECT doc_id, secret_hash, type, hits FROM findings")
def findings_hits(spark, sf_dir):
    return _findings(spark, sf_dir).select("doc_id", "secret_hash", "type", "hits")


@query("findings_proof", f"{S.FINDINGS} SELECT doc_id, proof, split_part(proof, ' · ', 1) AS kind, substr(secret_hash, 1, 8) AS short_hash FROM findings")
def findings_proof(spark, sf_dir):
    parts = X.split_proof(F.col("proof"))
    return _findings(spark, sf_dir).select("doc_id", "proof", parts["kind"].alias("kind"), F.translate(parts["hash"], "#", "").alias("short_hash"))


@query(
    "findings_alternation",
    f"""{S.FINDINGS}, bank AS (SELECT string_agg(regexp_escape(secret), '|' ORDER BY length(secret) DESC, secret) AS pattern FROM secrets),
hits AS (SELECT doc_id, unnest(regexp_extract_all(text, pattern)) AS secret FROM planted, bank WHERE pattern IS NOT NULL)
SELECT doc_id, sha256(secret) AS secret_hash, count(*) AS hits FROM hits GROUP BY doc_id, secret""",
)
def findings_alternation(spark, sf_dir):
    """Hits as one literal matcher of all secrets counts them."""
    docs, secrets = planted(spark, sf_dir), _vendor_secrets(spark, sf_dir)
    return known.alternation_hits(docs, secrets).select("doc_id", X.secret_hash(F.col("secret")).alias("secret_hash"), "hits")


@query("precision_partition", f"{S.FINDINGS} SELECT redactable, count(DISTINCT secret_hash) AS secrets, count(DISTINCT doc_id) AS files, CAST(sum(hits) AS BIGINT) AS hits FROM findings GROUP BY redactable")
def precision_partition(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("redactable").agg(F.count_distinct("secret_hash").alias("secrets"), F.count_distinct("doc_id").alias("files"), F.sum("hits").alias("hits"))


@query("docs_with_secrets", f"{S.FINDINGS} SELECT doc_id, source FROM planted WHERE doc_id IN (SELECT doc_id FROM findings)")
def docs_with_secrets(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", "source").join(_findings(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")


@query("docs_clean", f"{S.FINDINGS} SELECT doc_id, source FROM planted WHERE doc_id NOT IN (SELECT doc_id FROM findings)")
def docs_clean(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", "source").join(_findings(spark, sf_dir).select("doc_id"), "doc_id", "left_anti")


_ROLL = "count(DISTINCT doc_id) AS files, count(*) AS findings, CAST(sum(hits) AS BIGINT) AS hits, count(DISTINCT secret_hash) AS secrets"


@query("source_rollup", f"{S.FINDINGS} SELECT source, {_ROLL} FROM findings GROUP BY source")
def source_rollup(spark, sf_dir):
    return findings.rollup(_findings(spark, sf_dir), "source")


@query("type_rollup", f"{S.FINDINGS} SELECT type, {_ROLL} FROM findings WHERE NOT low_signal GROUP BY type")
def type_rollup(spark, sf_dir):
    return findings.rollup(_findings(spark, sf_dir).where(~F.col("low_signal")), "type")


@query(
    "report_sources",
    f"{S.FINDINGS}, f AS (SELECT source, doc_id, count(*) FILTER (WHERE NOT low_signal) AS c, coalesce(sum(hits) FILTER (WHERE NOT low_signal), 0) AS h FROM findings GROUP BY source, doc_id) "
    "SELECT source, count(*) AS files, CAST(sum(c) AS BIGINT) AS findings, CAST(sum(h) AS BIGINT) AS hits FROM f GROUP BY source",
)
def report_sources(spark, sf_dir):
    return findings.report_sources(_findings(spark, sf_dir))


@query(
    "report_patterns",
    f"{S.FINDINGS} SELECT type, count(DISTINCT doc_id) AS files, CAST(sum(hits) AS BIGINT) AS hits FROM findings WHERE NOT low_signal GROUP BY type ORDER BY 2 DESC, 3 DESC, lower(type), type LIMIT 20",
)
def report_patterns(spark, sf_dir):
    return findings.report_patterns(_findings(spark, sf_dir))


@query("findings_in_file_order", f"{S.FINDINGS} SELECT doc_id, sha256(secret) AS secret_hash, row_number() OVER (PARTITION BY doc_id ORDER BY raw_label, sha256(secret)) AS place FROM found")
def findings_in_file_order(spark, sf_dir):
    docs, secrets = planted(spark, sf_dir), _vendor_secrets(spark, sf_dir)
    typed = findings.with_types(known.match_known(docs, secrets), secrets)
    return findings.in_file_order(typed).select("doc_id", X.secret_hash(F.col("secret")).alias("secret_hash"), "place")


@query(
    "target_rollup",
    f"{S.FINDINGS} SELECT source, count(*) AS scanned, count(*) FILTER (WHERE f) AS flagged, round(100.0 * count(*) FILTER (WHERE f) / count(*), 6) AS share "
    "FROM (SELECT source, doc_id IN (SELECT doc_id FROM findings) AS f FROM planted) GROUP BY source",
)
def target_rollup(spark, sf_dir):
    out = findings.target_rollup(planted(spark, sf_dir).select("doc_id", "source"), _findings(spark, sf_dir), "source")
    return out.withColumn("share", F.round("share", 6))


@query(
    "target_redactable",
    f"{S.FINDINGS} SELECT source, count(DISTINCT doc_id) AS files, count(DISTINCT secret_hash) AS secrets, CAST(sum(hits) AS BIGINT) AS hits FROM findings WHERE redactable GROUP BY source",
)
def target_redactable(spark, sf_dir):
    return findings.rollup(_findings(spark, sf_dir).where("redactable"), "source").drop("findings")


@query("headline_totals", f"{S.FINDINGS} SELECT {_ROLL}, CAST(sum(hits) FILTER (WHERE redactable) AS BIGINT) AS redactable_hits FROM findings")
def headline_totals(spark, sf_dir):
    f = _findings(spark, sf_dir)
    return f.agg(
        F.count_distinct("doc_id").alias("files"), F.count(F.lit(1)).alias("findings"), F.sum("hits").alias("hits"), F.count_distinct("secret_hash").alias("secrets"),
        F.sum(F.when(F.col("redactable"), F.col("hits"))).alias("redactable_hits"),
    )


@query(
    "file_stats",
    f"{S.FINDINGS} SELECT doc_id, count(*) FILTER (WHERE NOT low_signal) AS credential_findings, CAST(coalesce(sum(hits) FILTER (WHERE NOT low_signal), 0) AS BIGINT) AS credential_hits, CAST(sum(hits) AS BIGINT) AS hits FROM findings GROUP BY doc_id",
)
def file_stats(spark, sf_dir):
    return findings.file_stats(_findings(spark, sf_dir), "doc_id")


@query(
    "top_exposed",
    f"{S.FINDINGS} SELECT doc_id, count(DISTINCT secret_hash) AS secrets, CAST(sum(hits) AS BIGINT) AS hits, max_by(proof, (CASE WHEN low_signal THEN 0 ELSE 1 END, hits, proof)) AS proof "
    "FROM findings WHERE redactable GROUP BY doc_id ORDER BY 2 DESC, 3 DESC, 1 LIMIT 5",
)
def top_exposed(spark, sf_dir):
    return findings.top_exposed(_findings(spark, sf_dir).where("redactable"), 5)


@query(
    "report_priority",
    f"{S.FINDINGS}, s AS (SELECT doc_id, count(*) FILTER (WHERE NOT low_signal) AS credential_findings, CAST(coalesce(sum(hits) FILTER (WHERE NOT low_signal), 0) AS BIGINT) AS credential_hits, CAST(sum(hits) AS BIGINT) AS hits FROM findings GROUP BY doc_id) "
    "SELECT *, row_number() OVER (ORDER BY credential_findings DESC, credential_hits DESC, hits DESC, doc_id) AS place FROM s",
)
def report_priority(spark, sf_dir):
    return findings.report_order(_findings(spark, sf_dir))


@query(
    "findings_first",
    f"{S.FINDINGS} SELECT doc_id, secret_hash, row_number() OVER w AS place, greatest(count(*) OVER (PARTITION BY doc_id) - 2, 0) AS more FROM findings "
    "WINDOW w AS (PARTITION BY doc_id ORDER BY hits DESC, lower(type), proof) QUALIFY place <= 2",
)
def findings_first(spark, sf_dir):
    out = findings.first_of_each(_findings(spark, sf_dir), 2)
    return out.select("doc_id", "secret_hash", long(F.col("place")).alias("place"), long(F.col("more")).alias("more"))


@query("top_types", f"{S.FINDINGS} SELECT type, CAST(sum(hits) AS BIGINT) AS hits FROM findings WHERE redactable GROUP BY type ORDER BY 2 DESC, 1 LIMIT 6")
def top_types(spark, sf_dir):
    return _findings(spark, sf_dir).where("redactable").groupBy("type").agg(F.sum("hits").alias("hits")).orderBy(F.desc("hits"), "type").limit(6)


# Rewriting -----------------------------------------------------------------------------------------------------------

_LITERAL = f"""{S.FINDINGS},
present AS (SELECT doc_id, list(secret ORDER BY length(secret) DESC, secret) AS secrets FROM found WHERE {S.high_precision(S.short_label('raw_label'))} GROUP BY doc_id),
done AS (
  SELECT p.doc_id, text AS before, CASE WHEN secrets IS NULL THEN text ELSE list_reduce(list_prepend(text, secrets), lambda a, s: replace(a, s, '{K.REDACTED}')) END AS text
  FROM planted p LEFT JOIN present ON present.doc_id = p.doc_id
)"""


def _strong_secrets(spark, sf_dir) -> DataFrame:
    return _vendor_secrets(spark, sf_dir).where(X.is_high_precision(X.short_label(F.col("raw_label"))))


def _redacted(spark, sf_dir, secrets: DataFrame | None = None) -> DataFrame:
    return known.redact_known(planted(spark, sf_dir), _strong_secrets(spark, sf_dir) if secrets is None else secrets)


@query("literal_redact", f"{_LITERAL} SELECT doc_id, text FROM done")
def literal_redact(spark, sf_dir):
    return _redacted(spark, sf_dir).select("doc_id", "text")


@query(
    "redaction_counts",
    f"{_LITERAL} SELECT doc_id, CAST(coalesce((length(text) - length(replace(text, '{K.REDACTED}', ''))) // {len(K.REDACTED)} - (length(before) - length(replace(before, '{K.REDACTED}', ''))) // {len(K.REDACTED)}, 0) AS BIGINT) AS redactions FROM done",
)
def redaction_counts(spark, sf_dir):
    """A dry run: the counts without the texts."""
    return _redacted(spark, sf_dir).select("doc_id", "redactions")


@query("redact_verify", f"{_LITERAL} SELECT doc_id FROM done JOIN (SELECT DISTINCT secret FROM found WHERE {S.high_precision(S.short_label('raw_label'))}) ON contains(text, secret)")
def redact_verify(spark, sf_dir):
    secrets = _strong_secrets(spark, sf_dir)
    return redact.survivors(_redacted(spark, sf_dir, secrets), secrets)


@query(
    "redact_verify_partly",
    f"{_LITERAL} SELECT DISTINCT doc_id FROM found WHERE {S.high_precision(S.short_label('raw_label'))} AND raw_label <> 'GitHub Token'",
)
def redact_verify_partly(spark, sf_dir):
    """Only the tokens of one label are rewritten, so the others must be found."""
    secrets = durable(_vendor_secrets(spark, sf_dir).where(X.is_high_precision(X.short_label(F.col("raw_label")))))
    return redact.survivors(known.redact_known(planted(spark, sf_dir), secrets.where("raw_label = 'GitHub Token'")), secrets)


@query(
    "jsonl_redact",
    """SELECT conv_id, turn, CASE WHEN text IS NULL THEN '{' || coalesce('"role":' || CAST(to_json(role) AS VARCHAR), '') || '}'
  ELSE '{' || coalesce('"role": ' || CAST(to_json(role) AS VARCHAR) || ', ', '') || '"content": ' || CAST(to_json('key [REDACTED] ' || text) AS VARCHAR) || '}' END AS line,
  CAST(CASE WHEN text IS NULL THEN 0 ELSE 1 END AS BIGINT) AS redactions FROM conversations""",
)
def jsonl_redact(spark, sf_dir):
    """Turns as JSON lines, each with a token in its content; lines without text have none and stay as they are."""
    token = F.concat(F.lit("key ghp_"), F.md5("text"), F.lit(" "), F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", token.alias("content"))).alias("line"))
    secrets = durable(detect.vendor_matches(rows, text="line").select("secret").distinct())
    return known.redact_known(rows, secrets, "line", json_lines=True)


@query(
    "table_redact",
    f"""SELECT c_custkey, replace(replace(c_name, 'Customer', '{K.REDACTED}'), 'BUILDING', '{K.REDACTED}') AS c_name,
  replace(replace(c_mktsegment, 'Customer', '{K.REDACTED}'), 'BUILDING', '{K.REDACTED}') AS c_mktsegment,
  CAST((length(c_name) - length(replace(c_name, 'Customer', ''))) // 8 + (length(c_mktsegment) - length(replace(c_mktsegment, 'BUILDING', ''))) // 8 AS BIGINT) AS redactions FROM customer""",
)
def table_redact(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return redact.redact_columns(rows, ["Customer", "BUILDING"], keys=["c_custkey"])


# Targets and paths ---------------------------------------------------------------------------------------------------

_HOME = "/home/u"
_TARGETS = [(t, r[0].replace("~", _HOME), d, f, s, i, 0) for i, (t, r, d, f, s) in enumerate(registry.REGISTRY) if "*" not in r[0]]
_TARGETS += [("outer", f"{_HOME}/.config", ["cache"], [], [".log"], len(registry.REGISTRY), 0)]
#: Paths below the targets, derived from documents.
_DIRS = ["sessions", "cache", "telemetry", "logs", "plugins"]
_NAMES = ["history.jsonl", "settings.json", "auth.json", ".mcp.json", "mcp.json", "run.log", "picture.png", "config.toml"]
_LIST = lambda xs: "[" + ", ".join(map(S.q, xs)) + "]"
_TARGET_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({S.q(t)}, {S.q(r)}, {_LIST(d)}::VARCHAR[], {_LIST(f)}::VARCHAR[], {_LIST(s)}::VARCHAR[], {i})" for t, r, d, f, s, i, _ in _TARGETS) + ") AS t(tool, root, dirs, files, suffixes, ordinal))"
_PATHS_SQL = f"""paths AS (
  SELECT doc_id, ({_LIST([t[1] for t in _TARGETS] + ['/srv/other'])})[doc_id % {len(_TARGETS) + 1} + 1] || '/' || ({_LIST(_DIRS)})[doc_id // 3 % {len(_DIRS)} + 1] || '/' || ({_LIST(_NAMES)})[doc_id // 7 % {len(_NAMES)} + 1] AS path
  FROM documents)"""


def _targets(spark) -> DataFrame:
    return spark.createDataFrame(_TARGETS, registry.SCHEMA)


def _paths(spark, sf_dir) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    id = F.col("doc_id")
    path = F.concat_ws("/", pick([t[1] for t in _TARGETS] + ["/srv/other"], id), pick(_DIRS, F.floor(id / 3)), pick(_NAMES, F.floor(id / 7)))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


@query(
    "path_exclusions",
    f"""WITH {_PATHS_SQL}
SELECT doc_id, tool, list_has_any(string_split(substr(path, length(root) + 1), '/'), dirs) AS by_dir,
  list_contains(files, string_split(path, '/')[-1]) OR len(list_filter(suffixes, lambda s: ends_with(path, s))) > 0 AS by_name
FROM paths JOIN {_TARGET_SQL} ON starts_with(path, root || '/')""",
)
def path_exclusions(spark, sf_dir):
    both = _paths(spark, sf_dir).join(F.broadcast(_targets(spark)), registry.is_under(F.col("path"), F.col("root")))
    return both.select(
        "doc_id",
        "tool",
        registry.excluded_by_dir(F.col("path"), F.col("exclude_dirs"), F.col("root")).alias("by_dir"),
        registry.excluded_by_name(F.col("path"), F.col("exclude_files"), F.col("exclude_suffixes")).alias("by_name"),
    )


@query(
    "managed_files",
    f"""WITH {_PATHS_SQL}
SELECT doc_id, path FROM paths WHERE (starts_with(path, '{_HOME}/') AND (substr(path, {len(_HOME) + 2}) IN {S.in_list(K.MANAGED_FILES)} OR starts_with(path, '{_HOME}/{K.MANAGED_FOLDER}/')))
  OR len(list_filter({_LIST(K.MANAGED_TAILS)}, lambda t: ends_with(path, '/' || t))) > 0 OR string_split(path, '/')[-1] = '{K.MANAGED_NAME}'""",
)
def managed_files(spark, sf_dir):
    return _paths(spark, sf_dir).where(registry.is_managed(F.col("path"), _HOME))


@query(
    "first_target_wins",
    f"WITH {_PATHS_SQL} SELECT p.doc_id, p.path, min_by(tool, ordinal) AS tool, min_by(substr(p.path, length(root) + 2), ordinal) AS relative FROM paths p LEFT JOIN {_TARGET_SQL} ON starts_with(path, root || '/') GROUP BY p.doc_id, p.path",
)
def first_target_wins(spark, sf_dir):
    return registry.owners(_paths(spark, sf_dir), _targets(spark)).drop("root")


@query(
    "only_filter",
    f"WITH {_PATHS_SQL} SELECT tool, count(*) AS files FROM paths JOIN {_TARGET_SQL} ON starts_with(path, root || '/') WHERE tool IN ('codex', 'zed', 'aider') GROUP BY tool",
)
def only_filter(spark, sf_dir):
    chosen = registry.only(_targets(spark), ["Codex,zed", "aider"])
    both = _paths(spark, sf_dir).join(F.broadcast(chosen), registry.is_under(F.col("path"), F.col("root")))
    return both.groupBy("tool").agg(F.count(F.lit(1)).alias("files"))


_CANDIDATES = [(t, r.replace("~", _HOME), i, j, (i + j) % 3 != 0) for i, (t, roots, *_) in enumerate(registry.REGISTRY) for j, r in enumerate(roots)]


@query(
    "discover_targets",
    f"""SELECT tool, root, CAST(ordinal AS BIGINT) AS ordinal FROM (
  SELECT *, rank() OVER (PARTITION BY tool ORDER BY candidate) AS r FROM {S.values(_CANDIDATES, 'tool', 'root', 'ordinal', 'candidate', 'here')} WHERE here
) WHERE r = 1 QUALIFY row_number() OVER (PARTITION BY root ORDER BY ordinal, candidate) = 1""",
)
def discover_targets(spark, sf_dir):
    rows = spark.createDataFrame([(t, r, [], [], [], i, j, e) for t, r, i, j, e in _CANDIDATES], registry.SCHEMA + ", exists boolean")
    return registry.discover(rows).select("tool", "root", long(F.col("ordinal")).alias("ordinal"))


@query(
    "managed_associated",
    f"WITH {_PATHS_SQL}, p AS (SELECT DISTINCT path FROM paths UNION SELECT '{_HOME}/.claude.json' UNION SELECT '{_HOME}/.aider.conf.yml') "
    f"SELECT DISTINCT path FROM p LEFT JOIN {_TARGET_SQL} ON starts_with(path, root || '/') AND tool IN ('claude', 'codex') WHERE tool IS NOT NULL OR path = '{_HOME}/.claude.json'",
)
def managed_associated(spark, sf_dir):
    extra = spark.createDataFrame([(f"{_HOME}/.claude.json",), (f"{_HOME}/.aider.conf.yml",)], "path string")
    paths = _paths(spark, sf_dir).select("path").union(extra).distinct()
    return registry.associated(paths, registry.only(_targets(spark), ["claude,codex"]).where("tool <> 'custom'"), _HOME)


@query(
    "path_shortened",
    f"WITH {_PATHS_SQL}, p AS (SELECT doc_id, substr(path, 2) || repeat('x', CAST(doc_id % 60 AS INTEGER)) AS path, doc_id % 2 = 0 AS bare FROM paths), b AS (SELECT doc_id, CASE WHEN bare THEN replace(path, '/', '-') ELSE path END AS path FROM p) "
    "SELECT doc_id, CASE WHEN length(path) <= 48 THEN path WHEN NOT contains(path, '/') THEN '…' || right(path, 47) ELSE split_part(path, '/', 1) || '/…/' || "
    "CASE WHEN length(split_part(path, '/', 1)) + length(split_part(path, '/', -1)) + 3 <= 48 THEN split_part(path, '/', -1) "
    "ELSE right(split_part(path, '/', -1), greatest(12, 45 - length(split_part(path, '/', 1)))) END END AS path FROM b",
)
def path_shortened(spark, sf_dir):
    rows = _paths(spark, sf_dir).withColumn("path", F.concat(F.substr("path", F.lit(2)), F.repeat(F.lit("x"), (F.col("doc_id") % 60).cast("int"))))
    rows = rows.withColumn("path", F.when(F.col("doc_id") % 2 == 0, F.replace("path", F.lit("/"), F.lit("-"))).otherwise(F.col("path")))
    return rows.select("doc_id", X.short_path(F.col("path")).alias("path"))


# State ---------------------------------------------------------------------------------------------------------------

_FILES_SQL = """files AS (SELECT 'd/' || doc_id AS path, doc_id * 10 AS mtime_ns, length(text) AS size, sha256(text) AS digest FROM documents),
cache AS (
  SELECT path, CASE WHEN n % 5 = 1 THEN mtime_ns - 1 ELSE mtime_ns END AS mtime_ns, size, CASE WHEN n % 5 = 2 THEN 'old' ELSE digest END AS digest, 100 AS cached_at,
    CASE WHEN n % 7 = 3 THEN 'f0' ELSE 'f1' END AS fingerprint
  FROM (SELECT *, CAST(substr(path, 3) AS BIGINT) AS n FROM files) WHERE n % 5 <> 4
)"""


def _state(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat(F.lit("d/"), F.col("doc_id")).alias("path"), (F.col("doc_id") * 10).alias("mtime_ns"), long(F.length("text")).alias("size"), state.digest(F.col("text")).alias("digest"))
    n = F.col("doc_id")
    cache = files.where(n % 5 != 4).select(
        "path",
        F.when(n % 5 == 1, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns")).alias("mtime_ns"),
        "size",
        F.when(n % 5 == 2, "old").otherwise(F.col("digest")).alias("digest"),
        F.lit(100).cast("long").alias("cached_at"),
        F.when(n % 7 == 3, "f0").otherwise("f1").alias("fingerprint"),
    )
    return files.drop("doc_id"), cache


@query("cache_needs_scan", f"WITH {_FILES_SQL} SELECT path FROM files f WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.path = f.path AND c.mtime_ns = f.mtime_ns AND c.size = f.size AND c.digest = f.digest)")
def cache_needs_scan(spark, sf_dir):
    return state.needs_scan(*_state(spark, sf_dir)).select("path")


@query(
    "cache_upsert",
    f"WITH {_FILES_SQL}, new AS (SELECT *, 200 AS cached_at, 'f1' AS fingerprint FROM files WHERE size % 2 = 0) SELECT path, CAST(mtime_ns AS BIGINT) AS mtime_ns, CAST(size AS BIGINT) AS size, digest, CAST(cached_at AS BIGINT) AS cached_at, fingerprint FROM new "
    "UNION ALL SELECT path, mtime_ns, size, digest, cached_at, fingerprint FROM cache WHERE path NOT IN (SELECT path FROM new)",
)
def cache_upsert(spark, sf_dir):
    files, cache = _state(spark, sf_dir)
    clean = files.where("size % 2 = 0").withColumns({"cached_at": F.lit(200).cast("long"), "fingerprint": F.lit("f1")})
    return state.mark_clean(cache, clean)


@query("cache_invalidate", f"WITH {_FILES_SQL} SELECT path FROM cache WHERE path NOT IN (SELECT path FROM files WHERE size % 3 = 0)")
def cache_invalidate(spark, sf_dir):
    files, cache = _state(spark, sf_dir)
    return state.invalidate(cache, files.where("size % 3 = 0")).select("path")


@query("cache_fingerprint", f"WITH {_FILES_SQL} SELECT path FROM cache WHERE fingerprint = 'f1'")
def cache_fingerprint(spark, sf_dir):
    return state.current(_state(spark, sf_dir)[1], "f1").select("path")


_BACKUPS_SQL = """b AS (
  SELECT 's' || event_id % 9 AS tool, strftime(ts, '%Y%m%d-%H%M%S') || CASE event_id % 4 WHEN 0 THEN '.partial' ELSE '' END || '.tar.gz' || CASE event_id % 3 WHEN 0 THEN '' ELSE '.enc' END || CASE event_id % 11 WHEN 0 THEN '.txt' ELSE '' END AS name,
    date_trunc('second', ts) AS created, event_id % 4 = 0 AS partial, event_id % 11 <> 0 AS good
  FROM events
)"""


def _backup_names(spark, sf_dir) -> DataFrame:
    id = F.col("event_id")
    name = F.concat(
        F.date_format("ts", "yyyyMMdd-HHmmss"), F.when(id % 4 == 0, ".partial").otherwise(""), F.lit(".tar.gz"), F.when(id % 3 == 0, "").otherwise(".enc"), F.when(id % 11 == 0, ".txt").otherwise("")
    )
    return table(spark, sf_dir, "events").select(F.concat(F.lit("s"), (id % 9).cast("string")).alias("tool"), name.alias("name")).distinct()


def _backups(spark, sf_dir) -> DataFrame:
    return state.backup_entries(_backup_names(spark, sf_dir))


@query("backup_rotation", f"WITH {_BACKUPS_SQL} SELECT tool, name FROM (SELECT DISTINCT tool, name, created FROM b WHERE good) QUALIFY row_number() OVER (PARTITION BY tool ORDER BY created DESC, name DESC) <= 3")
def backup_rotation(spark, sf_dir):
    return state.newest(_backups(spark, sf_dir), 3, "tool").select("tool", "name")


@query("restore_points", f"WITH {_BACKUPS_SQL} SELECT strftime(created, '%Y-%m-%d %H:%M:%S') AS created, array_to_string(list_sort(list(DISTINCT tool)), ',') AS tools, bool_or(partial) AS partial FROM b WHERE good GROUP BY 1")
def restore_points(spark, sf_dir):
    out = state.restore_points(_backups(spark, sf_dir))
    return out.select(F.date_format("created", "yyyy-MM-dd HH:mm:ss").alias("created"), F.array_join("tools", ",").alias("tools"), "partial")


@query("restore_snapshot", f"{_LITERAL} SELECT doc_id, before AS text, coalesce(before <> text, false) AS was_changed FROM done")
def restore_snapshot(spark, sf_dir):
    """Redact, save the rows that change to an encrypted snapshot, put them back from it: the corpus as it was, and which rows had changed."""
    docs, changed = planted(spark, sf_dir).select("doc_id", "text"), durable(_redacted(spark, sf_dir).select("doc_id", "text", "redactions"))
    path, key = new_path(spark, "snapshot"), "000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"
    state.snapshot(docs, changed.where("redactions > 0"), "doc_id", path, key)
    return state.restore(spark, changed, path, "doc_id", key).select("doc_id", "text", (F.col("redactions") > 0).alias("was_changed"))


@query(
    "known_backups",
    f"WITH {_BACKUPS_SQL} SELECT DISTINCT tool, name, '/h/' || tool AS root FROM b WHERE good AND tool IN ('s1', 's3', 's8')",
)
def known_backups(spark, sf_dir):
    """Backups of the tools s1, s3 and s8 only."""
    names = _backup_names(spark, sf_dir)
    targets = spark.createDataFrame([(t, f"/h/{t}", [], [], [], i, 0) for i, t in enumerate(("s1", "s3", "s8"))], registry.SCHEMA)
    return state.known_backups(names, targets).select("tool", "name", "root")


_LOGS_SQL = """logs AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN 'scan-' || event_id || '-summary.txt' WHEN 1 THEN 'scan-' || event_id || '.txt' WHEN 2 THEN 'scan-' || event_id || '-full.txt' WHEN 3 THEN 'cron-' || event_id || '.log' ELSE 'notes-' || event_id || '.txt' END AS name FROM events)"""


@query(
    "log_rotation",
    f"""WITH {_LOGS_SQL}, kinds AS (SELECT *, CASE event_id % 5 WHEN 0 THEN 's' WHEN 3 THEN 'l' ELSE 'r' END AS kind FROM logs WHERE event_id % 5 <> 4)
SELECT name FROM kinds QUALIFY kind = 's' OR row_number() OVER (PARTITION BY kind ORDER BY ts DESC, name DESC) > 30""",
)
def log_rotation(spark, sf_dir):
    id = F.col("event_id")
    made = lambda front, end: F.concat(F.lit(front), id.cast("string"), F.lit(end))
    name = F.when(id % 5 == 0, made("scan-", "-summary.txt")).when(id % 5 == 1, made("scan-", ".txt")).when(id % 5 == 2, made("scan-", "-full.txt")).when(id % 5 == 3, made("cron-", ".log")).otherwise(made("notes-", ".txt"))
    return state.stale_logs(table(spark, sf_dir, "events").select(name.alias("name"), F.col("ts").alias("modified"))).select("name")


@query("backup_age", "SELECT event_id, CASE d WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE d || 'd ago' END AS age FROM (SELECT event_id, CAST(floor((epoch(TIMESTAMP '2024-06-01 12:00:00') - floor(epoch(ts))) / 86400) AS BIGINT) AS d FROM events)")
def backup_age(spark, sf_dir):
    created = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", state.age(created, F.lit("2024-06-01 12:00:00").cast("timestamp")).alias("age"))


_DB_SQL = f"""{_FILES_SQL}, flagged AS (SELECT path FROM files WHERE size % 5 = 0), dbs AS (SELECT path || '.db' AS path, size % 3 AS redactions FROM files),
present AS (SELECT path || '.db-wal' AS path FROM files WHERE size % 2 = 0 UNION ALL SELECT path || '.db-shm' FROM files WHERE size % 7 = 0)"""


@query(
    "backup_files",
    f"WITH {_DB_SQL} SELECT path FROM flagged UNION SELECT path FROM dbs WHERE redactions > 0 UNION SELECT p.path FROM present p JOIN dbs d ON redactions > 0 AND p.path IN (d.path || '-wal', d.path || '-shm')",
)
def backup_files(spark, sf_dir):
    files, _ = _state(spark, sf_dir)
    dbs = files.select(F.concat("path", F.lit(".db")).alias("path"), (F.col("size") % 3).alias("redactions"))
    present = files.where("size % 2 = 0").select(F.concat("path", F.lit(".db-wal")).alias("path")).union(files.where("size % 7 = 0").select(F.concat("path", F.lit(".db-shm"))))
    return state.to_back_up(files.where("size % 5 = 0"), dbs, present)


@query("target_skip", f"WITH {_FILES_SQL} SELECT 't' || CAST(substr(f.path, 3) AS BIGINT) % 400 AS tool, bool_or(c.path IS NULL) AS needs_scan FROM files f LEFT JOIN cache c ON c.path = f.path AND c.mtime_ns = f.mtime_ns AND c.size = f.size AND c.digest = f.digest GROUP BY 1")
def target_skip(spark, sf_dir):
    """Targets none of whose files need a scan are skipped."""
    files, cache = _state(spark, sf_dir)
    todo = state.needs_scan(files, cache).select("path", F.lit(True).alias("_todo"))
    tool = F.concat(F.lit("t"), (F.substr("path", F.lit(3)).cast("long") % 400).cast("string"))
    return files.join(todo, "path", "left").groupBy(tool.alias("tool")).agg(F.bool_or(F.coalesce("_todo", F.lit(False))).alias("needs_scan"))


# Trees -----------------------------------------------------------------------------------------------------------------

_TREE_SQL = f"""place AS (
  SELECT doc_id, ({_LIST([t[1] for t in _TARGETS] + ['/srv/other'])})[doc_id % {len(_TARGETS) + 1} + 1] || '/' || ({_LIST(_DIRS)})[doc_id // 3 % {len(_DIRS)} + 1] || '/' || doc_id || '/' || ({_LIST(_NAMES)})[doc_id // 7 % {len(_NAMES)} + 1] AS path
  FROM documents),
tree AS (
  SELECT place.doc_id, path, text, doc_id % 10 = 3 AS nul, doc_id % 10 = 7 AS bad, octet_length(encode(coalesce(text, ''))) AS bytes,
    (starts_with(path, '{_HOME}/') AND (substr(path, {len(_HOME) + 2}) IN {S.in_list(K.MANAGED_FILES)} OR starts_with(path, '{_HOME}/{K.MANAGED_FOLDER}/')))
    OR len(list_filter({_LIST(K.MANAGED_TAILS)}, lambda t: ends_with(path, '/' || t))) > 0 OR string_split(path, '/')[-1] = '{K.MANAGED_NAME}' AS managed
  FROM place JOIN planted USING (doc_id) WHERE len(list_filter({_LIST(K.BINARY_SUFFIXES)}, lambda s: ends_with(path, s))) = 0),
scanned AS (
  SELECT * FROM tree t WHERE managed OR (NOT nul AND NOT (bad AND bytes < {K.SNIFF_BYTES}) AND EXISTS (SELECT 1 FROM {_TARGET_SQL} WHERE starts_with(path, root || '/')
    AND NOT list_has_any(string_split(substr(path, length(root) + 1), '/'), dirs)
    AND NOT (list_contains(files, string_split(path, '/')[-1]) OR len(list_filter(suffixes, lambda s: ends_with(path, s))) > 0))))"""


def _tree(spark, sf_dir) -> DataFrame:
    """The planted corpus as files below the targets and beside them: one in ten starts with a NUL, one in ten ends with a bad byte."""
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    id = F.col("doc_id")
    path = F.concat_ws("/", pick([t[1] for t in _TARGETS] + ["/srv/other"], id), pick(_DIRS, F.floor(id / 3)), id.cast("string"), pick(_NAMES, F.floor(id / 7)))
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    content = F.when(id % 10 == 3, F.concat(F.lit(b"\x00"), body)).when(id % 10 == 7, F.concat(body, F.lit(b"\xff"))).otherwise(body)
    return planted(spark, sf_dir).select(path.alias("path"), F.lit(0).cast("timestamp").alias("modified"), long(F.octet_length(content)).alias("size"), content.alias("content"))


def _scanned(spark, sf_dir) -> DataFrame:
    return trees.scanned(_tree(spark, sf_dir), _targets(spark), _HOME)


@query("tree_scan", f"WITH {PLANTED_SQL}, {_TREE_SQL} SELECT path, managed, length(coalesce(text, '')) + CASE WHEN nul OR bad THEN 1 ELSE 0 END AS chars FROM scanned")
def tree_scan(spark, sf_dir):
    """What is read of a tree: left out by folder or by name, binary by name or by their first bytes, and managed files all the same."""
    return _scanned(spark, sf_dir).select("path", "managed", long(F.length("text")).alias("chars"))


def _tree_findings(spark, sf_dir) -> DataFrame:
    secrets = _vendor_secrets(spark, sf_dir)
    read = _scanned(spark, sf_dir).select(F.struct("path", "managed").alias("own"), "text")
    hits = known.match_known(read, secrets, "own").select("own.path", "own.managed", "secret", "hits")
    return findings.findings(findings.with_types(hits, secrets), "path")


@query("tree_preserved", f"{S.FINDINGS}, {_TREE_SQL} SELECT managed, count(DISTINCT path) AS files, count(*) AS findings, CAST(sum(hits) AS BIGINT) AS hits FROM findings JOIN scanned USING (doc_id) GROUP BY managed")
def tree_preserved(spark, sf_dir):
    """Flagged files that may be rewritten, and managed ones that are reported and kept."""
    total = lambda f, managed: f.agg(F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("findings"), F.sum("hits").alias("hits")).select(F.lit(managed).alias("managed"), "*").where("files > 0")
    flagged, kept = findings.preserved(durable(_tree_findings(spark, sf_dir)))
    return total(flagged, False).unionByName(total(kept, True))


@query(
    "source_labels",
    f"""WITH {PLANTED_SQL}, {_TREE_SQL} SELECT path, coalesce(min_by(tool, ordinal), CASE WHEN starts_with(path, '{_HOME}/') THEN 'Managed credentials' ELSE '?' END) AS source,
  coalesce(min_by(substr(path, length(root) + 2), ordinal), CASE WHEN starts_with(path, '{_HOME}/') THEN substr(path, {len(_HOME) + 2}) ELSE path END) AS relative
FROM (SELECT path FROM tree UNION SELECT '{_HOME}/.claude.json') LEFT JOIN {_TARGET_SQL} ON starts_with(path, root || '/') GROUP BY path""",
)
def source_labels(spark, sf_dir):
    paths = _tree(spark, sf_dir).where(~trees.is_binary_name(F.col("path"))).select("path").union(spark.createDataFrame([(f"{_HOME}/.claude.json",)], "path string"))
    return registry.labels(paths, _targets(spark), _HOME)


@query(
    "redaction_totals",
    f"""{_LITERAL}, {_TREE_SQL} SELECT CAST(sum((length(d.text) - length(replace(d.text, '{K.REDACTED}', ''))) // {len(K.REDACTED)} - (length(before) - length(replace(before, '{K.REDACTED}', ''))) // {len(K.REDACTED)}) AS BIGINT) AS redactions,
  count(*) FILTER (WHERE d.text <> before) AS files, CAST(0 AS BIGINT) AS errors FROM done d JOIN scanned s ON s.doc_id = d.doc_id WHERE NOT managed""",
)
def redaction_totals(spark, sf_dir):
    """A dry run over the tree: what rewriting would change, in how many files, with how many errors. Managed files are left alone."""
    secrets = durable(_vendor_secrets(spark, sf_dir).where(X.is_high_precision(X.short_label(F.col("raw_label")))))
    done = trees.rewrite(known.redact_known(_scanned(spark, sf_dir).where("not managed").select("path", "text"), secrets), dry_run=True)
    return done.agg(F.sum("redactions").alias("redactions"), F.count(F.lit(1)).alias("files"), F.count("error").alias("errors"))


# Streams -------------------------------------------------------------------------------------------------------------


def _run_stream(df: DataFrame, spark: SparkSession) -> DataFrame:
    """All that is there, through a streaming query into a table of files, read back."""
    at = new_path(spark, "stream")
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out")
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def _run_totals(df: DataFrame, spark: SparkSession) -> DataFrame:
    """A streaming aggregate once all has arrived: each batch replaces the table of totals."""
    at = new_path(spark, "stream")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")
    q = df.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def _stream(spark, sf_dir, name) -> DataFrame:
    """The table's files as a stream, whether it is one file or a folder of them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


_TURN = "'turn ' || conv_id || ' ghp_' || md5(CAST(conv_id AS VARCHAR)) || ' ' || text"
_TURN_LINES = f"""t AS (SELECT *, string_split({_TURN}, chr(10)) AS lines FROM conversations),
looked AS (SELECT *, list_transform(lines, lambda l, i: length(l) + CASE WHEN i < len(lines) THEN 1 ELSE 0 END <= {K.DIRECT_REGEX_CHARS} OR {S.MARKER.replace('(text,', '(l,')}) AS look FROM t),
done AS (SELECT *, array_to_string(list_transform(lines, lambda l, i: CASE WHEN look[i] THEN regexp_replace(l, {_ANY}, '{K.REDACTED}', 'g') ELSE l END), chr(10)) AS out,
  CAST(coalesce(list_sum(list_transform(lines, lambda l, i: CASE WHEN look[i] THEN len(regexp_extract_all(l, {_ANY})) ELSE 0 END)), 0) AS BIGINT) AS n FROM looked)"""


def _turns(spark, sf_dir) -> DataFrame:
    text = F.concat(F.lit("turn "), F.col("conv_id"), F.lit(" ghp_"), F.md5(F.col("conv_id").cast("string")), F.lit(" "), F.col("text"))
    return _stream(spark, sf_dir, "conversations").withColumn("text", text)


@query("stream_line_redact", f"WITH {_TURN_LINES} SELECT conv_id, turn, out AS text, n AS redactions FROM done")
def stream_line_redact(spark, sf_dir):
    """Turns as they arrive, each cut at its newlines, so a turn of many lines is redacted like any other; null texts pass."""
    return _run_stream(streams.redact_turns(_turns(spark, sf_dir).select("conv_id", "turn", "text"), "text"), spark)


@query("stream_redaction_totals", f"WITH {_TURN_LINES} SELECT role, CAST(sum(n) AS BIGINT) AS redactions FROM done GROUP BY role")
def stream_redaction_totals(spark, sf_dir):
    """The running total of a stream, by role, once all has arrived."""
    done = streams.redact_turns(_turns(spark, sf_dir).select("role", "text"), "text")
    return _run_totals(done.groupBy("role").agg(F.sum("redactions").alias("redactions")), spark)


@query(
    "stream_chunk_redact",
    f"WITH t AS (SELECT conv_id, turn, string_split(coalesce(text, '') || ' ghp_' || md5(CAST(conv_id AS VARCHAR)), chr(10)) AS lines FROM conversations), "
    f"looked AS (SELECT *, list_transform(lines, lambda l: length(l) + 1 <= {K.DIRECT_REGEX_CHARS} OR {S.MARKER.replace('(text,', '(l,')}) AS look FROM t) "
    f"SELECT conv_id || '/' || turn AS stream, array_to_string(list_transform(lines, lambda l, i: CASE WHEN look[i] THEN regexp_replace(l, {_ANY}, '{K.REDACTED}', 'g') ELSE l END), chr(10)) || chr(10) AS text, "
    f"CAST(list_sum(list_transform(lines, lambda l, i: CASE WHEN look[i] THEN len(regexp_extract_all(l, {_ANY})) ELSE 0 END)) AS BIGINT) AS redactions FROM looked",
)
def stream_chunk_redact(spark, sf_dir):
    """Turns as chunk streams, a token across two chunks of each: their pieces, joined, are what one piece would give."""
    rows = _stream(spark, sf_dir, "conversations")
    token = F.concat(F.lit("ghp_"), F.md5(F.col("conv_id").cast("string")))
    parts = F.array(F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit(" "), F.substring(token, 1, 9)), F.concat(F.substr(token, F.lit(10)), F.lit("\n")))
    key = F.concat_ws("/", "conv_id", "turn")
    chunks = rows.select(key.alias("stream"), F.posexplode(parts).alias("seq", "chunk")).withColumn("is_last", F.col("seq") == 1)
    out = _run_stream(streams.redact_chunks(chunks.select("stream", long(F.col("seq")).alias("seq"), "chunk", "is_last")), spark)
    pieces = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return out.groupBy("stream").agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"), F.sum("redactions").alias("redactions"))
