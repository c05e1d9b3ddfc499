"""Every query of the library's own operators against its SQL."""

import pytest
from pyspark.sql import functions as F

from tests.comparing import both
from veilwork.plans import catalog
from veilwork.sources.tables import table


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    got, want = both(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name])
    assert got == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_null_texts_are_rows(spark, sf_dir, tmp_path):
    """Tables with null and empty texts give what their SQL gives, row for row."""
    docs = table(spark, sf_dir, "documents")
    docs.withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.lit(None)).when(F.col("doc_id") % 9 == 1, "").otherwise(F.col("text"))).write.parquet(str(tmp_path / "documents.parquet"))
    turns = table(spark, sf_dir, "conversations")
    turns.withColumns({"text": F.when(F.col("conv_id") % 3 != 0, F.col("text")), "role": F.when(F.col("turn") != 1, F.col("role"))}).write.parquet(str(tmp_path / "conversations.parquet"))
    names = ["short_text_redact", "short_text_gate_counts", "marker_gate", "entropy_redact", "redaction_counts", "literal_redact", "pii_redacted_text", "pii_exit_status", "docs_clean", "target_rollup", "restore_snapshot"]
    names += ["cache_needs_scan", "cache_upsert", "cache_invalidate", "target_skip", "tree_scan", "redaction_totals", "jsonl_redact", "stream_line_redact", "stream_redaction_totals", "stream_chunk_redact"]
    for name in names:
        got, want = both(spark, str(tmp_path), catalog.QUERIES[name], catalog.ORACLES[name])
        assert got == want, name
