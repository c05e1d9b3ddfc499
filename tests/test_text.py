"""Golden rows and differential tests of the text expressions and rewriting."""

import json
import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.comparing import both
from veilwork.functions import constants as K
from veilwork.functions import text as X
from veilwork.operators import detect, findings, known, redact
from veilwork.plans import catalog
from veilwork.sources.tables import table

GHP = "ghp_" + "a1B2" * 9
MIXED = "Ab3dEf6hIj9lMn2pQr5tUv8xYz1bCd4fGh7jKl0nOp3rSt6vWx9zAb2dEf5hIj8l"


def one(spark, expr, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns)).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "shown"), [("jwt", "JWT"), ("github-pat", "GitHub PAT"), ("npm access token fine grained", "NPM Token"), ("unknown", "Secret"), ("my_api-thing", "My API Thing")])
def test_short_label(spark, raw, shown):
    assert one(spark, X.short_label(F.col("s")), s=raw) == shown


@pytest.mark.parametrize(("label", "high"), [("JWT", True), ("jwt", True), ("npm-token", True), ("Postgres URI", False), ("Bearer Token", False), ("Generic Secret", False)])
def test_precision(spark, label, high):
    assert one(spark, X.is_high_precision(F.col("s")), s=label) is high


def test_proof(spark):
    assert one(spark, X.proof(F.col("s"), F.lit("jwt")), s="short12").startswith("JWT · #")
    shown = one(spark, X.proof(F.col("s"), F.lit("github-pat")), s=GHP)
    assert shown.startswith("GitHub PAT · ghp_a1…a1B2 · #"[:17]) and GHP not in shown


SHORT = [
    (f"remote: token={GHP}", "remote: token=[REDACTED]", 1),
    ("a\nb\nAKIA" + "A1B2" * 4 + "\nc", "a\nb\n[REDACTED]\nc", 1),
    ("clean\n" * 8 + GHP, "clean\n" * 8 + GHP, 0),
    ("x" * 9000 + GHP, "x" * 9000 + GHP, 0),
    ("", "", 0),
]


@pytest.mark.parametrize(("text", "out", "n"), SHORT)
def test_short_text(spark, text, out, n):
    row = redact.redact_short_text(spark.createDataFrame([(text,)], "text string")).first()
    assert (row["text"], row["redactions"]) == (out, n) == redact.short_text(text)


def test_null_text(spark):
    row = redact.redact_short_text(spark.createDataFrame([(None,)], "text string")).first()
    assert (row["text"], row["redactions"]) == (None, 0)


def test_entropy_is_opt_in(spark):
    df = spark.createDataFrame([(f"value={MIXED}",)], "text string")
    assert redact.redact_short_text(df).first()["redactions"] == 0
    row = redact.redact_short_text(df, high_entropy=True).first()
    assert (row["text"], row["redactions"]) == ("value=[REDACTED]", 1)


def test_known_secrets_longest_first(spark):
    df = redact.redact_short_text(spark.createDataFrame([("abcdefgh12 abcdefgh",)], "text string"), secrets=["abcdefgh", "abcdefgh12"])
    assert df.first()["text"] == "[REDACTED] [REDACTED]"


def test_entropy_redaction_equals_python(spark):
    rng = random.Random(5)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789_@+/.-= é"
    texts = ["".join(rng.choices(signs, weights=[8] * 46 + [1] * 9, k=rng.randint(0, 160))) for _ in range(300)]
    texts += ["plain \x01 text \x02 end", f"\x01{MIXED}\x02 \x03{MIXED}", MIXED, f"{MIXED} {MIXED}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = df.select("id", redact.redact_entropy(F.col("text")).alias("r")).collect()
    for r in rows:
        n = 0

        def swap(m):
            nonlocal n
            if redact.looks_random(m[0]):
                n += 1
                return K.REDACTED
            return m[0]

        assert (re.sub(K.ENTROPY_CANDIDATE, swap, texts[r["id"]]), n) == (r["r"]["text"], r["r"]["count"])


def test_spans_equal_python(spark):
    rng = random.Random(6)
    parts = ["a.b@c.de", "http://x.y/(z).", "10.0.0.256", "1.2.3.4", "472-81-0094", "4111 1111 1111 1111", "é", "😀", " ", "\n", "x", "\x01", "(", ")"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for label, pattern in K.PII.items():
        want = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", pattern))
        for r in df.select("id", X.find_spans(F.col("text"), pattern).alias("s")).collect():
            assert [(s["start"], s["end"]) for s in r["s"]] == [m.span() for m in want.finditer(texts[r["id"]].replace("\x01", "\x03"))], label


GOLDEN_PII = [
    ("my SSN is 472-81-0094.", "my SSN is [SSN_1]."),
    ("Email me at alex.rivera@example.com or visit https://example.com/profile.", "Email me at [EMAIL_1] or visit [URL_1]."),
    ("My card is 4111111111111111.", "My card is [CREDIT_CARD_1]."),
    ("1.2.3.4 then 5.6.7.8 then 1.2.3.4", "[IP_ADDRESS_1] then [IP_ADDRESS_2] then [IP_ADDRESS_1]"),
    ("nothing", "nothing"),
    ("", ""),
]


@pytest.mark.parametrize(("text", "out"), GOLDEN_PII)
def test_pii_redaction(spark, text, out):
    df = spark.createDataFrame([(text,)], "text string").withColumn("s", detect.resolve(detect.pii_spans(F.col("text"))))
    df = df.withColumn("p", redact.placeholders(F.col("s"), F.col("text"))).select(redact.replace_spans(F.col("text"), F.col("p")).alias("x"))
    assert df.first()["x"] == out


def test_normalize(spark):
    row = spark.createDataFrame([("Mi nombre es José García.",)], "t string").select(detect.normalize("t").alias("n")).first()["n"]
    assert row["text"] == "mi nombre es jose garcia." and row["offsets"][13] == 13


def test_folding_makes_no_places(spark, sf_dir, tmp_path):
    """A batch of texts costs little beside its own size, and null texts stay null as in SQL."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("aÀéZß ﬁŉ😀", k=rng.randint(0, 30))) for _ in range(700)]
    assert detect.folded.func(pa.array([*texts, None])).to_pylist() == [*(detect.normalized(t)[0] for t in texts), None]
    batch = pa.array(["Ab c" * 250] * 4000)
    tracemalloc.start()
    detect.folded.func(batch)
    detect.normalize.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6
    turns = table(spark, sf_dir, "conversations")
    turns.withColumn("text", F.when(F.col("turn") % 3 != 0, F.col("text"))).write.parquet(str(tmp_path / "conversations.parquet"))
    got, want = both(spark, str(tmp_path), catalog.QUERIES["text_normalize"], catalog.ORACLES["text_normalize"])
    assert got == want


def test_model_spans_yield_to_rules(spark):
    def model(texts):
        return [[("GIVEN_NAME", 0, 4, 0.9), ("CITY", 5, 9, 0.9), ("PHONE", 10, 20, 0.3), ("EMAIL", 22, 30, 0.8)] for _ in texts]

    df = spark.createDataFrame([("Alex Rome 555-123456, a@bcd.ef x",)], "text string")
    df = detect.model_spans(df, model).withColumn("s", detect.merge_model(detect.pii_spans(F.col("text")), F.col("model_spans")))
    assert [(s["label"], s["start"], s["end"]) for s in df.first()["s"]] == [("GIVEN_NAME", 0, 4), ("EMAIL", 22, 30)]


def test_json_lines(spark):
    secret = "s3cret-value-1"
    lines = '{"a": "x s3cret-value-1", "n": 1e5}\n{"a": "clean",  "b": 1}\nplain s3cret-value-1\n{"s3cret-value-1": [1, "s3cret-value-1"]}'
    df = known.redact_known(spark.createDataFrame([(1, lines)], "doc_id long, text string"), spark.createDataFrame([(secret,)], "secret string"), json_lines=True)
    row = df.first()
    assert row["text"] == '{"a": "x [REDACTED]", "n": 100000.0}\n{"a": "clean",  "b": 1}\nplain [REDACTED]\n{"[REDACTED]": [1, "[REDACTED]"]}'
    assert row["redactions"] == 4


def test_findings_and_survivors(spark):
    docs = spark.createDataFrame([(1, f"{GHP} and {GHP}"), (2, "AKIA" + "B2" * 8), (3, None), (4, "clean")], "doc_id long, text string")
    secrets = detect.vendor_matches(docs).select("secret", F.col("label").alias("raw_label")).distinct()
    hits = known.match_known(docs, secrets)
    assert sorted((r["doc_id"], r["hits"]) for r in hits.collect()) == [(1, 2), (2, 1)]
    found = findings.findings(findings.with_types(hits, secrets))
    assert findings.top_exposed(found).first()["doc_id"] == 1
    clean = known.redact_known(docs, secrets)
    assert redact.survivors(clean, secrets).count() == 0
    again = known.redact_known(clean.drop("redactions"), secrets)
    assert again.agg(F.sum("redactions")).first()[0] == 0


def test_alternation_takes_the_longest(spark):
    docs = spark.createDataFrame([(1, "abcdefgh12 abcdefgh")], "doc_id long, text string")
    secrets = spark.createDataFrame([("abcdefgh",), ("abcdefgh12",)], "secret string")
    assert {(r["secret"], r["hits"]) for r in known.alternation_hits(docs, secrets).collect()} == {("abcdefgh", 1), ("abcdefgh12", 1)}
    assert {(r["secret"], r["hits"]) for r in known.match_known(docs, secrets).collect()} == {("abcdefgh", 2), ("abcdefgh12", 1)}


def test_detector_precedence(spark):
    a = spark.createDataFrame([("secret-one-1", "jwt", "x", 2), ("short", "jwt", "x", 1)], "secret string, raw_label string, detector string, priority int")
    b = spark.createDataFrame([("secret-one-1", "aws", "y", 1)], a.schema)
    assert [(r["secret"], r["raw_label"], r["detectors"]) for r in detect.detections(a, b).collect()] == [("secret-one-1", "aws", ["x", "y"])]


def plain_present(text, secrets):
    return sorted((s for s in secrets if s in text), key=lambda s: (-len(s), s))


def test_rounds_change_nothing(spark, monkeypatch):
    """Many rounds of few secrets give what one round gives: findings, alternation and redaction, prefixes of each other included."""
    rng = random.Random(11)
    secrets = ["secret11x", "secret11xLONGTAIL9", "xLONG", "ab", "abab", 'q"uote', "täil", "LONGTAIL9 s"] + [f"key{i}{'z' * (i % 4)}" for i in range(12)]
    parts = [*secrets, " ", "x", "\n", "é", "abc"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(80)] + [None, ""]
    lines = [json.dumps({"a": t, "b": [t]}, ensure_ascii=rng.random() < 0.5) if t is not None else None for t in texts]
    frame = lambda ts: spark.createDataFrame([(i, t, 1) for i, t in enumerate(ts)], "doc_id long, text string, row int").repartition(3)
    rows = spark.createDataFrame([(s,) for s in [*secrets, secrets[0], ""]], "secret string")
    got = []
    for most, chars in ((200_000, 20_000_000), (2, 20_000_000), (200_000, 30)):
        monkeypatch.setattr(known, "MOST", most)
        monkeypatch.setattr(known, "MOST_CHARS", chars)
        out = [sorted(map(tuple, f(frame(texts), rows).collect())) for f in (known.match_known, known.alternation_hits)]
        out += [sorted(map(tuple, known.redact_known(frame(t), rows, json_lines=j).collect())) for t, j in ((texts, False), (lines, True))]
        got.append(out)
    assert got[0] == got[1] == got[2]
    bank = re.compile("|".join(map(re.escape, known.longest_first(secrets))))
    hits, spans, texts_out, lines_out = got[0]
    assert hits == sorted((i, s, t.count(s)) for i, t in enumerate(texts) if t for s in secrets if s in t)
    assert spans == sorted((i, s, n) for i, t in enumerate(texts) if t for s, n in Counter(bank.findall(t)).items())
    assert [(t, n) for _, t, _, n in texts_out] == [known.redact_line(t, plain_present(t, secrets)) if t else (t, 0) for t in texts]
    assert not any(s in t for _, t, _, _ in lines_out if t for s in secrets if s != 'q"uote' and s.isascii())


def test_a_tail_of_a_longer_secret_never_stays(spark, monkeypatch):
    monkeypatch.setattr(known, "MOST", 1)
    df = spark.createDataFrame([(1, "a secret11xLONGTAIL9 b secret11x")], "doc_id long, text string")
    rows = spark.createDataFrame([("secret11x",), ("secret11xLONGTAIL9",)], "secret string")
    assert known.redact_known(df, rows).first()["text"] == "a [REDACTED] b [REDACTED]"


def test_secrets_that_only_show_decoded(spark):
    """In a line with a known secret all its values are decoded."""
    line = '{"a": "plain-one", "b": "caf\\u00e9-key"}'
    df = spark.createDataFrame([(1, line + "\n" + line.replace("plain-one", "x"))], "doc_id long, text string")
    row = known.redact_known(df, spark.createDataFrame([("plain-one",), ("café-key",)], "secret string"), json_lines=True).first()
    assert row["text"].split("\n")[0] == '{"a": "[REDACTED]", "b": "[REDACTED]"}' and row["redactions"] == 2


@pytest.mark.parametrize(("label", "start"), [("GitHub PAT", "github_pat_"), ("Slack Webhook", "https://hooks.slack.com/services/"), ("SendGrid Key", "SG."), ("Telegram Token", ""), ("Azure Key", "AccountKey")])
def test_plain_starts(label, start):
    assert X.literal_start(dict(K.VENDOR)[label]) == start


def test_searches_stand_once_in_a_plan(spark, sf_dir):
    """Explode over a computed array must not make the planner compute it twice."""
    for name, what, most in (("pii_spans_resolved", "regexp_replace", 15), ("vendor_token_matches", "regexp_extract_all", 1)):
        plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count(what + "(") <= most, name


def test_model_sees_normalized_chunks(spark):
    def model(texts):
        return [[("GIVEN_NAME", m.start(), m.end(), 0.5 + 0.1 * (m.start() % 2)) for m in re.finditer("jose|ana", t)] for t in texts]

    text = "Ñ é José x Ana " * 3
    df = detect.model_spans(spark.createDataFrame([(text,), (None,), ("",)], "text string"), model, chunk=24, overlap=10)
    rows = [r["model_spans"] for r in df.collect()]
    assert [text[s["start"] : s["end"]] for s in rows[0]] == ["José", "Ana"] * 3 and rows[1:] == [[], []]


def test_scores_decide_between_equal_model_spans(spark):
    model = lambda ts: [[("GIVEN_NAME", 0, 4, 0.6), ("SURNAME", 0, 4, 0.9), ("CITY", 5, 9, 1.0)] for _ in ts]
    df = detect.model_spans(spark.createDataFrame([("Alex Rome",)], "text string"), model).withColumn("s", detect.merge_model(detect.pii_spans(F.col("text")), F.col("model_spans")))
    assert [s["label"] for s in df.first()["s"]] == ["SURNAME"]


def test_windows_of_tokens():
    assert detect.windows(0) == [(0, 0)] and detect.windows(510) == [(0, 510)]
    assert detect.windows(1000) == [(0, 510), (446, 956), (892, 1000)]


def test_lines_of_a_turn(spark):
    text = "clean\n" * 9 + f"token={GHP}\n" + "x" * 9000 + " " + GHP
    df = spark.createDataFrame([(text,), (None,), ("",)], "value string")
    rows = redact.redact_lines(df, "value").collect()
    assert [(r["value"], r["redactions"]) for r in rows] == [(text.replace(GHP, "[REDACTED]"), 2), (None, 0), ("", 0)]
