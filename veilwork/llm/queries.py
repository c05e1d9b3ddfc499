"""All queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import q_native, q_search, q_text

MODULES = (q_native, q_text, q_search)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()} | {"pipeline": pipeline}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
