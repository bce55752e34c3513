"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import stages
from brindle.llm.common import settle

STAGES = [
    ("quality classifier", stages.keep_good),
    ("simhash near-dedup", stages.keep_one_of_each),
    ("benchmark decontamination", stages.drop_leaks),
    ("secret scans", stages.mask_secrets),
    ("best-fit packing", stages.pack_all),
]

#: Token ids, learned scores and fingerprints are beyond SQL: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read back for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
