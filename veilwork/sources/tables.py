"""Tables of a folder, and the corpus with planted secrets that is derived from ``documents``."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HERE = str(Path(__file__).resolve().parents[2])


def findable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever their working folder; --py-files does so on a cluster."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _HERE not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_HERE, *paths])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    findable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def planted(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` with one made-up secret in seven of eight texts, in front of every third one and behind the others; null texts stay null."""
    docs = table(spark, folder, "documents")
    id = F.col("doc_id").cast("string")
    m = F.md5(id)
    d = F.lpad(F.pmod("doc_id", F.lit(10_000)).cast("string"), 4, "0")
    token = (
        F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("ghp_"), m))
        .when(F.col("doc_id") % 8 == 1, F.concat(F.lit("AKIA"), F.upper(F.substring(m, 1, 16))))
        .when(F.col("doc_id") % 8 == 2, F.concat(F.lit("npm_"), m))
        .when(F.col("doc_id") % 8 == 3, F.concat(F.lit("eyJ"), m, F.lit("."), m, F.lit("."), m))
        .when(F.col("doc_id") % 8 == 4, F.concat(F.substring(d, 1, 3), F.lit("-"), F.substring(d, 2, 2), F.lit("-"), d))
        .when(F.col("doc_id") % 8 == 5, F.concat(F.lit("(see https://example.com/d/"), id, F.lit(").")))
        .when(F.col("doc_id") % 8 == 6, F.base64(F.unhex(F.sha2(id, 256))))
        .otherwise("")
    )
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(token, F.lit(" "), F.col("text"))).otherwise(F.concat(F.col("text"), F.lit(" "), token))
    return docs.select("doc_id", "source", "lang", text.alias("text"))


#: The same in DuckDB's SQL, as a common table expression.
PLANTED_SQL = """
planted AS (
  SELECT doc_id, source, lang, CASE WHEN doc_id % 3 = 0 THEN tok || ' ' || text ELSE text || ' ' || tok END AS text
  FROM (
    SELECT *, CASE doc_id % 8
      WHEN 0 THEN 'ghp_' || m
      WHEN 1 THEN 'AKIA' || upper(substr(m, 1, 16))
      WHEN 2 THEN 'npm_' || m
      WHEN 3 THEN 'eyJ' || m || '.' || m || '.' || m
      WHEN 4 THEN substr(d, 1, 3) || '-' || substr(d, 2, 2) || '-' || d
      WHEN 5 THEN '(see https://example.com/d/' || id || ').'
      WHEN 6 THEN base64(unhex(sha256(id)))
      ELSE '' END AS tok
    FROM (SELECT *, CAST(doc_id AS VARCHAR) AS id, md5(CAST(doc_id AS VARCHAR)) AS m, lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS d
          FROM documents)
  )
)"""
