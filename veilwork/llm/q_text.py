"""Queries op1 and op7; their results are tokenizer output, which SQL has not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import packing, tokens
from ._util import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op1_packing": op1_packing, "op7_token_counts": op7_token_counts}
ORACLES: dict[str, str] = {}
