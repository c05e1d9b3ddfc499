"""Streams give what one piece would, however it is cut."""

import json
import random
import time

from veilwork.operators import redact
from veilwork.plans.catalog import _run_stream
from veilwork.streaming.text import MOST_TOKEN, Buffer, redact_chunks, until_detected

GHP = "ghp_" + "a1B2" * 9


def test_chunk_borders():
    text = "x" * 60 + GHP + "!" * 40
    b, out = Buffer(most=64), []
    for i in range(0, len(text), 7):
        out += b.feed(text[i : i + 7])
    out += b.finish()
    assert "".join(t for t, _ in out) == "x" * 60 + "[REDACTED]" + "!" * 40 and sum(n for _, n in out) == 1


def test_any_chunking_is_the_same():
    rng = random.Random(1)
    lines = "".join(f"line {i} {GHP if i % 3 == 0 else 'clean'}\n" for i in range(50))
    want = "".join(redact.short_text(x)[0] for x in lines.splitlines(keepends=True))
    for _ in range(20):
        b, out, at = Buffer(), [], 0
        while at < len(lines):
            n = rng.randint(1, 90)
            out += b.feed(lines[at : at + n])
            at += n
        out += b.finish()
        assert "".join(t for t, _ in out) == want


def test_long_lines(spark):
    line = "y " * 5000 + GHP + "\n"
    for strict, n in ((True, 0), (False, 1)):
        b = Buffer(strict=strict)
        out = [*b.feed(line), *b.finish()]
        assert sum(k for _, k in out) == n


def test_stateful_query(spark, tmp_path):
    rows = [{"stream": "s", "seq": i, "chunk": c, "is_last": i == 2} for i, c in enumerate(["a ghp_a1B2", "a1B2" * 8 + "\nb", "c"])]
    (tmp_path / "in.json").write_text("\n".join(map(json.dumps, rows)))
    chunks = spark.readStream.schema("stream string, seq long, chunk string, is_last boolean").json(str(tmp_path))
    out = _run_stream(redact_chunks(chunks), spark).orderBy("seq").collect()
    assert [(r["text"], r["redactions"]) for r in out] == [("a [REDACTED]\n", 1), ("bc", 0)]


def test_a_token_without_an_end_is_given_up():
    """It goes out as one redaction, and its rest is not shown either."""
    b, out = Buffer(), list(Buffer().feed(""))
    for chunk in ["see ghp_", *["a" * 4000] * 80, "a end\n", f"next {GHP}\n"]:
        out += b.feed(chunk)
        assert len(b.pending) <= 2 * MOST_TOKEN + 4096
    assert "".join(t for t, _ in [*out, *b.finish()]) == "see [REDACTED] end\nnext [REDACTED]\n"


def test_idle_streams_are_flushed(spark, tmp_path):
    """Without a last chunk the rest goes out once the stream has been idle."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"stream": "s", "seq": 0, "chunk": f"rest {GHP}", "is_last": False}))
    chunks = spark.readStream.schema("stream string, seq long, chunk string, is_last boolean").json(str(tmp_path / "in"))
    q = redact_chunks(chunks, idle="1 second").writeStream.format("memory").queryName("idle_out").trigger(processingTime="500 milliseconds").start()
    try:
        for i in range(60):
            time.sleep(1)
            (tmp_path / "in" / f"b{i}.json").write_text(json.dumps({"stream": "other", "seq": i, "chunk": "x", "is_last": False}))
            rows = spark.sql("SELECT * FROM idle_out WHERE stream = 's'").collect()
            if rows:
                break
    finally:
        q.stop()
    assert [(r["text"], r["redactions"]) for r in rows] == [("rest [REDACTED]", 1)]


def test_stops_when_detected(spark, tmp_path):
    (tmp_path / "a.txt").write_text(f"token={GHP}\n")
    seen = []
    q = until_detected(spark.readStream.text(str(tmp_path)), lambda df, n: seen.append((df.first()["value"], n)))
    q.awaitTermination(60)
    assert seen == [("token=[REDACTED]", 1)] and not q.isActive
