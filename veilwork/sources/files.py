"""Trees of text files and SQLite databases as DataFrames, what of them is scanned, and writing them back."""

from __future__ import annotations

import os
import re
import sqlite3
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from . import registry


def _hidden(root: str) -> Iterator[tuple]:
    """(path, modified, size) of the files of a folder here that Spark's reader leaves out: those with a part that starts with a dot or an underscore."""
    root = re.sub("^file:/*", "/", root).rstrip("/") or "/"
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", root):
        return
    for folder, _, names in os.walk(root):
        below = folder[len(root) :].split("/")
        for name in names:
            path = os.path.join(folder, name)
            if any(x.startswith((".", "_")) for x in (*below, name)) and os.path.isfile(path):
                facts = os.stat(path)
                yield path, datetime.fromtimestamp(facts.st_mtime), facts.st_size


def list_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Rows (path, modified, size, content) of all files below ``roots``; a query that leaves ``content`` out never reads it.

    Spark's reader takes folders of any store, and leaves out hidden files. Those are added for folders of this machine, or of a mount
    that all executors have; in other stores they are not seen. Empty files give no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    files = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")

    @F.pandas_udf("binary")
    def read(paths: pd.Series) -> pd.Series:
        return pd.Series([Path(p).read_bytes() if os.path.isfile(p) else None for p in paths], dtype=object)

    hidden = spark.createDataFrame(sorted({x for root in roots for x in _hidden(root) if x[2]}), "path string, modified timestamp, size long")
    return files.unionByName(hidden.withColumn("content", read("path")))


def is_binary_name(path: Column) -> Column:
    """A name that ends in one of the suffixes and is more than the suffix."""
    return F.exists(F.array(*map(F.lit, K.BINARY_SUFFIXES)), lambda s: F.endswith(path, s) & ~F.endswith(path, F.concat(F.lit("/"), s)))


def starts_as_text(content: Column) -> Column:
    """The first SNIFF_BYTES hold no NUL and are UTF-8, but for a character that their end cuts."""
    front = F.substring(content, 1, K.SNIFF_BYTES)
    less = lambda k: F.try_validate_utf8(F.substring(content, 1, K.SNIFF_BYTES - k).cast("string")).isNotNull()
    cut = F.octet_length(content) > K.SNIFF_BYTES
    return ~F.contains(front, F.lit(b"\x00")) & (less(0) | (cut & (less(1) | less(2) | less(3))))


def text_files(files: DataFrame, most_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """Files that are text by name, size and their first bytes, which are asked in that order; ``text`` has bad bytes further on as U+FFFD."""
    kept = files.where((F.col("size") <= most_bytes) & ~is_binary_name(F.col("path"))).where(starts_as_text(F.col("content")))
    return kept.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).drop("content")


def managed_files(files: DataFrame, home: str, most_bytes: int = K.MAX_FILE_BYTES) -> DataFrame:
    """The credential files among ``files`` that are looked at: not binary by name, not too large."""
    return files.where(registry.is_managed(F.col("path"), home) & ~is_binary_name(F.col("path")) & (F.col("size") <= most_bytes))


def scanned(files: DataFrame, targets: DataFrame, home: str, chosen: bool = False) -> DataFrame:
    """The text files that a scan reads, once each, with ``managed``: those below a target that it does not leave out, and the managed ones.

    A file left out by name is read all the same if it is managed; one in a folder left out is not, unless it is managed by its place.
    With ``chosen``, only managed files of the given targets are added.
    """
    texts = text_files(files)
    below = F.broadcast(targets.select("root", "exclude_dirs", "exclude_files", "exclude_suffixes"))  # a fixed registry
    path = F.col("path")
    left_out = registry.excluded(path, F.col("root"), F.col("exclude_dirs"), F.col("exclude_files"), F.col("exclude_suffixes"), home)
    held = texts.join(below, registry.is_under(path, F.col("root")) & ~left_out, "left_semi")
    managed = managed_files(files, home)
    if chosen:
        managed = managed.join(registry.associated(managed.select("path"), targets, home), "path", "left_semi")
    managed = managed.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).select(*held.columns)
    both = held.unionByName(managed.join(held.select("path"), "path", "left_anti"))
    return both.withColumn("managed", registry.is_managed(path, home))


# Databases -----------------------------------------------------------------------------------------------------------

DATABASES = (".sqlite", ".db", ".vscdb")


def _open(content: bytes) -> sqlite3.Connection:
    """The database of ``content``, in memory."""
    db = sqlite3.connect(":memory:")
    data = bytearray(content)
    if data[18:20] == b"\x02\x02":  # a write-ahead log needs a file; what is not yet in the main file is not there
        data[18:20] = b"\x01\x01"
    if data:
        db.deserialize(bytes(data))
    return db


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _text_columns(db: sqlite3.Connection):
    """(table, column) of those that may be rewritten: declared as text or as nothing, no keys and no unique ones."""
    for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'").fetchall():
        if name.startswith("_sqlx"):
            continue
        unique = set()
        for index in db.execute(f"PRAGMA index_list({_quoted(name)})").fetchall():
            if index[2]:
                unique |= {r[2] for r in db.execute(f"PRAGMA index_info({_quoted(index[1])})")}
        for _, column, kind, _, _, key in db.execute(f"PRAGMA table_info({_quoted(name)})").fetchall():
            if not key and column not in unique and ("text" in kind.lower() or not kind):
                yield name, column


def _cells(db: sqlite3.Connection):
    for name, column in list(_text_columns(db)):
        for rowid, value in db.execute(f"SELECT rowid, {_quoted(column)} FROM {_quoted(name)}").fetchall():
            if isinstance(value, str) and value:
                yield name, column, rowid, value


def databases(files: DataFrame) -> DataFrame:
    ends = F.endswith("path", F.lit(DATABASES[0]))
    for s in DATABASES[1:]:
        ends = ends | F.endswith("path", F.lit(s))
    return files.where(ends)


_CELLS = pa.schema([("path", pa.string()), ("table", pa.string()), ("column", pa.string()), ("rowid", pa.int64()), ("value", pa.string()), ("error", pa.string())])


def sqlite_cells(files: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """Rows (path, table, column, rowid, value, error) of the text cells that may be rewritten.

    A file that is no database, or larger than ``most_bytes``, is one row with its error and without a value.
    """

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    db = _open(content)
                    try:
                        rows = [(path, *r, None) for r in _cells(db)]
                    finally:
                        db.close()
                except sqlite3.Error as e:
                    rows = [(path, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CELLS)], schema=_CELLS)

    found = databases(files)
    small = found.where(F.col("size") <= most_bytes).select("path", "content")
    schema = "path string, table string, column string, rowid long, value string, error string"
    large = found.where(F.col("size") > most_bytes).selectExpr(
        "path", "string(null) AS table", "string(null) AS column", "bigint(null) AS rowid", "string(null) AS value", f"concat('larger than {most_bytes} bytes: ', size) AS error"
    )
    return small.mapInArrow(read, schema).unionByName(large)


_REWRITTEN = pa.schema([("path", pa.string()), ("redactions", pa.int64()), ("error", pa.string()), ("content", pa.binary())])


def redact_sqlite(files: DataFrame, secrets: list[str], most_bytes: int = 1 << 30) -> DataFrame:
    """Rows (path, redactions, error, content) of the databases that hold a secret or cannot be read; ``content`` is the rewritten file.

    An error counts as -1 and has no content. ``secrets`` are those to be rewritten, a short list; more are matched on ``sqlite_cells``.
    """
    from ..operators.known import longest_first, redact_line

    ordered = longest_first(s for s in secrets if s)

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    db, total = _open(content), 0
                    try:
                        for name, column, rowid, value in list(_cells(db)):
                            new, n = redact_line(value, ordered)
                            if n:
                                db.execute(f"UPDATE {_quoted(name)} SET {_quoted(column)} = ? WHERE rowid = ?", (new, rowid))
                                total += n
                        db.commit()
                        if total:
                            rows.append((path, total, None, db.serialize()))
                    finally:
                        db.close()
                except sqlite3.Error as e:
                    rows.append((path, -1, str(e), None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_REWRITTEN)], schema=_REWRITTEN)

    found = databases(files)
    large = found.where(F.col("size") > most_bytes).selectExpr("path", "-1L AS redactions", f"concat('larger than {most_bytes} bytes: ', size) AS error", "binary(null) AS content")
    return found.where(F.col("size") <= most_bytes).select("path", "content").mapInArrow(run, "path string, redactions long, error string, content binary").unionByName(large)


# Writing back --------------------------------------------------------------------------------------------------------

_WRITTEN = pa.schema([("path", pa.string()), ("redactions", pa.int64()), ("error", pa.string())])


def rewrite(changed: DataFrame, dry_run: bool = False) -> DataFrame:
    """Put ``content`` (or, as UTF-8, ``text``) of rows (path, redactions, ...) in place of the files; rows (path, redactions, error).

    Only rows with redactions are written. Each goes to a file beside the old one, takes over its mode and replaces it in one step, so a
    task that is run again, or stops midway, leaves a whole file. Executors must see the paths: this is for trees on one machine or on
    a shared mount. What cannot be written keeps its old content and has its error in its row.
    """
    text = "content" not in changed.columns
    rows = changed.where("redactions > 0").select("path", "redactions", F.col("text" if text else "content").cast("binary").alias("content"))
    if dry_run:
        return rows.select("path", "redactions", F.lit(None).cast("string").alias("error"))

    def run(batches):
        for batch in batches:
            errors = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                beside = f"{path}.{os.getpid()}.rewritten"
                try:
                    mode = os.stat(path).st_mode & 0o7777
                    with open(beside, "wb") as f:
                        f.write(content)
                        f.flush()
                        os.fsync(f.fileno())
                    os.chmod(beside, mode)
                    os.replace(beside, path)
                    errors.append(None)
                except OSError as e:
                    if os.path.exists(beside):
                        os.unlink(beside)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(errors, pa.string())], schema=_WRITTEN)

    return rows.mapInArrow(run, "path string, redactions long, error string")
