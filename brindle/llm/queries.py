"""The ``opN_<name>`` queries: each applies one operator of this subpackage to its whole table, as its contract says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op6_rules_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import read_tokens, write_tokens

    path = new_path(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1, path)
    return read_tokens(spark, path, manifest)


def op2_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranking import held_out, rank_quality

    scored = rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(), columns=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_simhash_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import find_items

    found = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("leaks", lambda x: x["item_id"]))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), F.array_join(items, ",").alias("item_ids"))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive

    return archive(table(spark, sf_dir, "pages"), segment_bytes=4096, least_shared=1000)


def op9_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op10_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


_ALL = (
    op1_best_fit_packing,
    op2_bradley_terry_quality,
    op3_simhash_vantage_trees,
    op4_benchmark_decontamination,
    op5_secret_ownership,
    op6_rules_isolation_forest,
    op7_token_files,
    op8_warc_segments,
    op9_license_diagonals,
    op10_html_blocks,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {}
