"""Reports over the chunk store and the query log: one aggregation job per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import not_deleted


def count_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("id").alias("total_documents"))


def dashboard(chunks: DataFrame, logs: DataFrame, today: str | None = None) -> DataFrame:
    """One row of corpus and log figures; ``today`` (a date, UTC) is the current one if not given. Deleted rows count.

    Chunks are summed per file first, so the two distinct counts need no expansion of the rows.
    """
    day = F.current_date() if today is None else F.lit(today).cast("date")
    files = chunks.groupBy("filename").agg(F.count("id").alias("n"), F.sum(F.length("content")).alias("chars"), F.max(F.to_date("created_at") == day).alias("fresh"))
    corpus = files.agg(
        F.count("filename").alias("total_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"), F.coalesce(F.sum("chars"), F.lit(0)).alias("total_chars"),
        F.count(F.when(F.col("fresh"), F.col("filename"))).alias("documents_ingested_today"),
    )
    asked = logs.agg(
        F.count("id").alias("total_queries"), F.coalesce(F.avg("response_time_ms"), F.lit(0.0)).cast("int").alias("avg_query_response_time_ms"),
        F.count_if(F.to_date("created_at") == day).alias("queries_today"),
    )
    average = F.when(F.col("total_chunks") > 0, F.expr("total_chars div total_chunks")).otherwise(F.lit(0).cast("long"))
    return corpus.crossJoin(asked).withColumn("avg_chunk_size", average)  # one row by one row


def embedding_load(texts: DataFrame, batch: int = 128, text_col: str = "text") -> DataFrame:
    """What an embedding service gets: texts, requests of ``batch`` texts, and the average input in whole characters."""
    n, chars = F.count(text_col), F.coalesce(F.sum(F.length(text_col)), F.lit(0))
    return texts.agg(n.alias("n_texts"), F.ceil(n / batch).alias("n_requests"), F.floor(chars / F.greatest(n, F.lit(1))).alias("avg_input"))


def file_summary(chunks: DataFrame) -> DataFrame:
    return chunks.where(not_deleted()).groupBy("filename").agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("total_chars"))


def chunk_report(chunks: DataFrame, filename: str | None = None) -> DataFrame:
    """Length, head, kind and header of each chunk, with the file's running total of characters."""
    rows = chunks.where(not_deleted()) if filename is None else chunks.where(not_deleted() & (F.col("filename") == filename))
    size = F.length(F.coalesce("content", F.lit("")))
    so_far = Window.partitionBy("filename").orderBy("chunk_index", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "id", "filename", "chunk_index", size.alias("chars"), F.substring("content", 1, 300).alias("head"), F.get_json_object("doc_metadata", "$.doc_type").alias("doc_type"),
        F.get_json_object("doc_metadata", "$.header").alias("header"), F.sum(size).over(so_far).alias("running_chars"),
    )


def iso(ts: Column) -> Column:
    """A time as text: fractions of a second only where there are some."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def last_ingestion(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.coalesce(iso(F.max("created_at")), F.lit("Never")).alias("last_ingestion"))


def all_chunks(chunks: DataFrame) -> DataFrame:
    """Every row, deleted ones too, without its vector (which is then never read)."""
    return chunks.drop("embedding")


def document_list(chunks: DataFrame) -> DataFrame:
    return all_chunks(chunks).select(
        "id", "filename", "unit", "collection", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), iso(F.col("created_at")).alias("created_at"),
        F.coalesce("doc_metadata", F.lit("{}")).alias("metadata"), F.length(F.coalesce("content", F.lit(""))).alias("size_chars"),
    )


def by_id(chunks: DataFrame, key: int) -> DataFrame:
    return all_chunks(chunks).where(F.col("id") == key)


def by_filename(chunks: DataFrame, filename: str) -> DataFrame:
    """A file's chunks in order."""
    return all_chunks(chunks).where(F.col("filename") == filename).orderBy("chunk_index", "id")


def system_info(chunks: DataFrame, embedding_dim: int = 2048, models: dict[str, str] | None = None) -> DataFrame:
    """One row about the engine: versions, models and the last ingestion."""
    models = models or {}
    return last_ingestion(chunks).select(
        F.lit("2.0").alias("api_version"), F.lit(f"spark {chunks.sparkSession.version}").alias("store"), F.lit(models.get("embedding", "hashing")).alias("embedding_model"),
        F.lit(embedding_dim).alias("embedding_dim"), F.lit(models.get("text", "extractive")).alias("text_model"), "last_ingestion",
    )


def health(probes: dict[str, bool]) -> str:
    return "healthy" if all(probes.values()) else "degraded"


def ingestion_summary(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per file: status, chunks, tokens, error. ``files``: filename, text (null where it could not be read), error."""
    made = chunks.groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
    ok = F.col("error").isNull()
    return files.join(made, "filename", "left").select(
        "filename", F.when(ok, "success").otherwise("error").alias("status"), F.when(ok, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("chunks_ingested"),
        F.when(ok, F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)).otherwise(F.lit(0)).cast("long").alias("total_tokens"), "error",
    )
