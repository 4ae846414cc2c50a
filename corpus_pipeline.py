"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing, packing.

Each stage reads what the one before it wrote; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.durable import discard, materialize, scope
from weirflow.llm import lines, mixing, packing, quality, simhash

STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: quality.filter_documents(docs)),
    ("line_dedup", lambda spark, docs, sf_dir: lines.dedup_lines(docs)),
    ("simhash_dedup", lambda spark, docs, sf_dir: simhash.drop_near_duplicates(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.mix_documents(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack_documents(docs)),
]

#: SQL can express neither the line and near-duplicate stages nor the packing; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again.

    A stage's own tables, and what the stage before it wrote, go as soon as its result stands.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scope(spark) as keep:
            out = keep(materialize(stage(spark, docs, sf_dir), name))
        if k:
            discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
