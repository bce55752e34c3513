"""Continuous forms: files that arrive are ingested, and the query log is summed by day as it grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sinks.store import DocumentStore
from ..sources.files import PdfReader, extracted


def daily_queries(logs: DataFrame, late: str = "1 day") -> DataFrame:
    """day, n_queries, total_ms per day of the log; rows later than ``late`` behind the newest are dropped once a day closed."""
    days = logs.withWatermark("created_at", late).groupBy(F.window("created_at", "1 day").alias("w"))
    return days.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("response_time_ms").alias("total_ms")).select(F.to_date("w.start").alias("day"), "n_queries", "total_ms")


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is now and read what it made. In complete mode each batch replaces the table."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        write = lambda df, _: df.write.mode("overwrite").parquet(out)
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def ingest_folder(spark: SparkSession, folder: str, store: DocumentStore, make_chunks: Callable[[DataFrame], DataFrame], checkpoint: str, unit: str | None = None, collection: str | None = None, pdf: PdfReader | None = None) -> StreamingQuery:
    """Ingest the files that a folder holds and gets. A file that comes again replaces its chunks, also by none, so a batch
    that is tried again does no harm. A file that cannot be read keeps what it had and is noted (filename, error) in the
    store's ``ingest_errors``, in a folder per batch. ``make_chunks``: extracted files (filename, text, html_format) to chunk rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")

    def batch(df: DataFrame, number: int) -> None:
        done, at = store.staged(extracted(df, pdf))  # files are read once
        read = done.where("error is null")
        rows = make_chunks(read).withColumns({"unit": F.lit(unit).cast("string"), "collection": F.lit(collection).cast("string")})
        store.replace_all(rows, unit, collection, names=read)
        done.where("error is not null").select("filename", "error").write.mode("overwrite").parquet(store.path(f"ingest_errors/batch={number}"))
        store.discard(at)

    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
