"""The corpus pipeline's stages: each takes (spark, docs, sf_dir), and its operator's decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Columns stay as they are, whatever their names; a null or
    empty text is scored like any other; repeated rows stay or go together; ties (a score of just 0.5) stay; without
    labels all stay; an empty table gives none."""
    from .ranking import held_out, rank_quality

    score, kept = fresh(docs, "score", "predicted")
    return rank_quality(docs, table(spark, sf_dir, "labels"), ~held_out(), into=(score, kept)).where(F.col(kept) == 1).drop(score, kept)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more),
    found by SimHash fingerprints in vantage-point trees and decided by the shingles. Rows are known by doc_id and text:
    of rows equal in both one stays, and of rows with one doc_id and texts of different groups each may stay. Texts
    without words (nulls too) are one group; rows without a doc_id all stay; an empty table gives none."""
    from .shingles import first_of_each

    text, head, hash_ = fresh(docs, "text_hash", "f_id", "f_hash")
    named = docs.where("doc_id is not null").withColumn(text, F.xxhash64("text"))
    first = first_of_each(named).select(F.col("doc_id").alias(head), F.col("h").alias(hash_))
    one = named.join(first, (F.col("doc_id") == F.col(head)) & (F.col(text) == F.col(hash_)), "left_semi").dropDuplicates(["doc_id", text]).select(*docs.columns)
    return one.unionByName(docs.where("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. A null or empty text holds none; repeated rows stay or go together; with an
    empty benchmark all stay; columns stay as they are."""
    from .decontam import decontaminate

    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking credentials masked; n_chars follows the text. A null text stays null; rows with one
    doc_id and text are masked alike; spans that overlap have one mask; an empty table gives none; other columns stay."""
    from .secrets import redact, scan

    key, owned = fresh(docs, "text_hash", "owned")
    found = scan(docs).where(F.size("owned") > 0).select(F.col("_id").alias("f_id"), F.col("_h").alias("f_hash"), F.col("owned").alias(owned)).dropDuplicates(["f_id", "f_hash"])
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = (keyed[key] == found["f_hash"]) & keyed["doc_id"].eqNullSafe(found["f_id"])
    text = F.when(found[owned].isNull(), keyed["text"]).otherwise(redact(keyed["text"], found[owned]))
    masked = keyed.join(found, same, "left").select(*[text.alias(c) if c == "text" else keyed[c] for c in docs.columns])
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_all(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's pieces, packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is
    empty (one piece); repeated rows are packed once each; ties in length go by doc_id and piece; an empty table gives none."""
    from .packing import pack_documents
    from .queries import vocabulary

    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)
