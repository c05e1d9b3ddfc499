"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import durable as durable
from ..sources.tables import table as table

#: Words of the size and shingle contracts: runs of anything but space and \t to \r.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(col):
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_held: dict = {}


def sole(key, make):
    """What ``make`` gives, kept by this Python worker beyond its tasks until another key is asked for: one cache a worker at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


#: Rows of an Arrow batch of texts, where the session has Spark's default of 10,000, which can be hundreds of MB a task on both sides.
BATCH = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session set to Arrow batches that fit texts, unless it has a setting of its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH))
    return df


def slices(batches, rows: int = 512, cached: bool = False) -> Iterator:
    """The Arrow batches in pieces of so many rows, which are made Python objects one piece at a time.

    Workers outlive their tasks, so memory that a task is done with goes back to the system, and unless the task is ``cached`` the
    cache that earlier ones left goes first.
    """
    if not cached:
        _held.clear()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    release()


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


#: Bits of a sieve: 2 MB, whatever it holds.
SIEVE = 1 << 24


def sieve(keys: Column, wanted: DataFrame) -> Column:
    """False only where ``keys`` (a 64-bit hash) is none of the hashes ``wanted`` (key); few others are true.

    One bitmap of SIEVE bits goes to all tasks. Rows that it lets through must be joined on the keys themselves; the more keys
    there are, the more rows that are, and the result stays the same.
    """
    spark = wanted.sparkSession
    place = lambda c: F.pmod(c, F.lit(SIEVE)) + 1
    held = wanted.select(place(F.col("key")).alias("x")).distinct()
    maps = held.groupBy(F.bitmap_bucket_number("x").alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    table = np.zeros(SIEVE // 8, np.uint8)
    for r in maps.collect():  # SIEVE bits at most
        table[(r["i"] - 1) * 4096 : r["i"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def met(x: pd.Series) -> pd.Series:
        at = x.to_numpy() - 1
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return met(place(keys))
