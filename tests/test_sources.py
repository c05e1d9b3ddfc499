"""File trees, databases, targets and state."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from veilwork.operators import findings, known, state
from veilwork.sources import files, registry, shared

GHP = "ghp_" + "a1B2" * 9


def test_text_files(spark, tmp_path):
    """The first bytes decide; bad ones further on do not hide a file."""
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello é")
    (tmp_path / "sub" / "b.jsonl").write_text("{}")
    (tmp_path / "c.png").write_text("text in a picture's name")
    (tmp_path / "d.txt").write_bytes(b"nul\0byte")
    (tmp_path / "e.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "f.txt").write_bytes(b"x" * 10_000 + GHP.encode() + b"\xff end")
    (tmp_path / "g.txt").write_bytes(("x" * 4095 + "é and more").encode())
    (tmp_path / "h.txt").write_bytes(("x" * 4094 + "😀").encode() + b"\0")
    (tmp_path / "i.txt").write_bytes(b"x" * 4000 + b"\xff" + b"y" * 4000)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "_k.txt").write_text("hidden")
    (tmp_path / ".l").write_bytes(b"\0")
    rows = files.text_files(files.list_files(spark, [str(tmp_path)])).collect()
    want = {"a.txt": "hello é", "b.jsonl": "{}", "f.txt": "x" * 10_000 + GHP + "\ufffd end", "g.txt": "x" * 4095 + "é and more", "h.txt": "x" * 4094 + "😀\0", "_k.txt": "hidden"}
    assert {os.path.basename(r["path"]): r["text"] for r in rows} == want


def make_database(path, mode="delete"):
    db = sqlite3.connect(path)
    db.execute(f"PRAGMA journal_mode = {mode}")
    db.execute("CREATE TABLE ItemTable (key TEXT PRIMARY KEY, value TEXT, n INTEGER, u TEXT UNIQUE, bare)")
    db.execute("CREATE TABLE _sqlx_own (value TEXT)")
    db.execute("INSERT INTO ItemTable VALUES ('Bearer x', 'Bearer x, Bearer xy', 1, 'Bearer x', 'none'), ('k2', NULL, 2, NULL, NULL)")
    db.execute("INSERT INTO _sqlx_own VALUES ('Bearer x')")
    db.commit()
    db.execute("PRAGMA wal_checkpoint(TRUNCATE)")
    db.close()


def test_sqlite(spark, tmp_path):
    """Cells, errors and sizes are reported; rewriting leaves keys, unique columns and other tables alone."""
    make_database(tmp_path / "state.vscdb")
    make_database(tmp_path / "wal.db", "wal")
    (tmp_path / "bad.db").write_text("no database, but as long as the header of one would be" * 20)
    (tmp_path / "empty.sqlite").write_bytes(b"")
    (tmp_path / "other.txt").write_text("x")
    tree = files.list_files(spark, [str(tmp_path)])
    rows = files.sqlite_cells(tree).collect()
    name = lambda r: os.path.basename(r["path"])
    assert sorted((name(r), r["column"], r["value"]) for r in rows if r["error"] is None) == sorted((n, c, v) for n in ("state.vscdb", "wal.db") for c, v in (("value", "Bearer x, Bearer xy"), ("bare", "none")))
    assert [name(r) for r in rows if r["error"]] == ["bad.db"]
    assert {name(r) for r in files.sqlite_cells(tree, most_bytes=100).collect() if r["error"]} == {"state.vscdb", "wal.db", "bad.db"}
    changed = files.redact_sqlite(tree, ["Bearer x", "Bearer xy"])
    assert sorted((name(r), r["redactions"]) for r in changed.collect()) == [("bad.db", -1), ("state.vscdb", 2), ("wal.db", 2)]
    before = (tmp_path / "state.vscdb").read_bytes()
    assert files.rewrite(changed, dry_run=True).count() == 2 and (tmp_path / "state.vscdb").read_bytes() == before
    assert sorted((name(r), r["redactions"], r["error"]) for r in files.rewrite(changed).collect()) == [("state.vscdb", 2, None), ("wal.db", 2, None)]
    for n in ("state.vscdb", "wal.db"):
        db = sqlite3.connect(tmp_path / n)
        assert db.execute("SELECT * FROM ItemTable ORDER BY n").fetchall() == [("Bearer x", "[REDACTED], [REDACTED]", 1, "Bearer x", "none"), ("k2", None, 2, None, None)]
        assert db.execute("SELECT * FROM _sqlx_own").fetchall() == [("Bearer x",)]
        db.close()
    assert sorted(os.listdir(tmp_path)) == ["bad.db", "empty.sqlite", "other.txt", "state.vscdb", "wal.db"]


def test_rewriting_files(spark, tmp_path):
    """Files that hold a secret are replaced in place, with their mode; others, and a dry run, change nothing."""
    lines = '{"content": "use ' + GHP + '"}\n{"b":  1}\nplain ' + GHP
    (tmp_path / "a.jsonl").write_text(lines)
    (tmp_path / "b.txt").write_text("clean")
    os.chmod(tmp_path / "a.jsonl", 0o640)
    texts = files.text_files(files.list_files(spark, [str(tmp_path)])).select("path", "text")
    changed = known.redact_known(texts, spark.createDataFrame([(GHP,)], "secret string"), json_lines=True)
    assert [(r["redactions"], r["error"]) for r in files.rewrite(changed, dry_run=True).collect()] == [(2, None)]
    assert (tmp_path / "a.jsonl").read_text() == lines
    assert [(r["redactions"], r["error"]) for r in files.rewrite(changed).collect()] == [(2, None)]
    assert (tmp_path / "a.jsonl").read_text() == '{"content": "use [REDACTED]"}\n{"b":  1}\nplain [REDACTED]'
    assert os.stat(tmp_path / "a.jsonl").st_mode & 0o777 == 0o640 and sorted(os.listdir(tmp_path)) == ["a.jsonl", "b.txt"]
    gone = spark.createDataFrame([(str(tmp_path / "no" / "file"), "x", 1)], "path string, text string, redactions long")
    row = files.rewrite(gone).first()
    assert row["redactions"] == 1 and "No such file" in row["error"]


def test_scan_of_a_tree(spark, tmp_path, monkeypatch):
    home = str(tmp_path)
    for name in (".claude/p/a.jsonl", ".claude/cache/b.jsonl", ".claude/settings.json", ".codex/x/notes.txt", ".codex/config.toml", "work/c.txt", ".mcp.json", ".claude/cache/.mcp.json"):
        os.makedirs(os.path.dirname(f"{home}/{name}"), exist_ok=True)
        (tmp_path / name).write_text("text")
    targets = spark.createDataFrame([("claude", f"{home}/.claude", ["cache"], ["settings.json"], [], 0, 0)], registry.SCHEMA)
    tree = files.list_files(spark, [home])
    short = lambda df: {(r["path"][len(home) + 1 :], r["managed"]) for r in df.collect()}
    below = {(".claude/p/a.jsonl", False), (".claude/settings.json", True), (".claude/cache/.mcp.json", True)}
    assert short(files.scanned(tree, targets, home)) == below | {(".codex/config.toml", True), (".mcp.json", True)}
    assert short(files.scanned(tree, targets, home, chosen=True)) == below


def test_registry_discovers_first_root(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    for d in (".claude", ".windsurf", ".codeium/windsurf"):
        (tmp_path / d).mkdir(parents=True)
    found = registry.discover(registry.candidates_here(spark, registry.REGISTRY)).collect()
    assert {(r["tool"], r["root"]) for r in found} == {("claude", f"{tmp_path}/.claude"), ("windsurf", f"{tmp_path}/.codeium/windsurf")}


def test_only_rejects_unknown_tools(spark):
    targets = spark.createDataFrame([("a", "/a", [], [], [], 0, 0)], registry.SCHEMA)
    assert registry.only(targets, ["A"]).count() == 1
    with pytest.raises(ValueError, match="unknown"):
        registry.only(targets, ["b"])


def test_snapshot_and_restore(spark, tmp_path):
    docs = spark.createDataFrame([(1, "old one"), (2, "old two"), (3, None)], "id long, text string")
    for key in (None, "00112233445566778899aabbccddeeff"):
        at = str(tmp_path / f"snap{key}")
        state.snapshot(docs, docs.where("id < 3"), "id", at, key)
        changed = docs.selectExpr("id", "'new' AS text")
        back = state.restore(spark, changed, at, "id", key)
        assert {r["id"]: r["text"] for r in back.collect()} == {1: "old one", 2: "old two", 3: "new"}


def test_snapshots_hide_the_key_and_the_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "old one", "src", None)], "id long, text string, source string, n int")
    key = "00112233445566778899aabbccddeeff"
    state.snapshot(docs, docs, "id", str(tmp_path / "s"), key)
    held = spark.read.parquet(str(tmp_path / "s"))
    assert held.columns == ["id", "_row"] and "old" not in str(held.collect())
    plan = state.restore(spark, docs, str(tmp_path / "s"), "id", key)._jdf.queryExecution().toString()
    assert key not in plan.lower() and "AAECAw" not in plan


def test_numbering_without_one_task(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("v"))
    rows = findings.numbered(df, [F.desc("v"), F.asc("id")]).collect()
    assert {r["id"]: r["place"] for r in rows} == {r["id"]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r["v"], r["id"])))}
    assert findings.numbered(df.limit(0), [F.asc("id")]).count() == 0


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_folder(Cluster)


def test_custom_targets(spark):
    rows = spark.createDataFrame(registry.custom(["/srv/x/", "/"], 9), registry.SCHEMA)
    assert [(r["tool"], r["root"], r["ordinal"]) for r in rows.collect()] == [("custom", "/srv/x", 9), ("custom", "/", 10)]


def test_backup_names(spark):
    names = [("t", "20260101-120000.tar.gz.enc"), ("t", "20260102-120000.partial.tar.gz.enc"), ("t", "readme.txt"), ("t", "20261399-120000.tar.gz")]
    rows = state.backup_entries(spark.createDataFrame(names, "tool string, name string")).collect()
    assert sorted((str(r["created"]), r["partial"], r["encrypted"]) for r in rows) == [("2026-01-01 12:00:00", False, True), ("2026-01-02 12:00:00", True, True)]


def test_fingerprint_changes():
    assert state.fingerprint("1", {"a": "1"}) != state.fingerprint("1", {"a": "2"})
