"""A training corpus from raw documents: quality rules, near-dedup, PII, mixing, encoding.

Each stage is one operator of quillspark.llm over all documents that the stage before it kept. Stages are
written to the shared folder as Parquet and read again, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, mixing, neardup, pii, quality
from quillspark.llm.common import keep, read_table

STAGES = [
    ("quality rules", quality.stage),
    ("minhash near-dedup", neardup.stage),
    ("pii", pii.stage),
    ("mixing sources to target weights", mixing.stage),
    ("bpe encoding and decoding", bpe.stage),
]
#: Near-dedup, mixing and BPE are beyond SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one adds n_tokens, ids_sha256 and decoded_sha256."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, f"stage{i}")
    return docs
