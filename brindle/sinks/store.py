"""The document store: Parquet tables with append, scoped delete and replace on re-ingest.

Chunks are partitioned by unit, collection and a bucket of the file name. A delete or a re-ingest rewrites the
partitions that hold rows of the named files alone: they are read, filtered, staged in a table of their own and put in
place by one dynamic partition overwrite, so no file is read while it is overwritten. Pure functions give the same
results as DataFrames where nothing is to be written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TABLES

#: Buckets of file names in each unit and collection: a re-ingest rewrites one of so many parts.
BUCKETS = 16
#: Unit and collection of rows that have none (a partition needs a value).
NO_SCOPE = "__none__"


def in_scope(filename: str, unit: str | None = None, collection: str | None = None) -> Column:
    """The file's rows; in all units and collections where none is given."""
    out = F.col("filename") == filename
    for c, v in (("unit", unit), ("collection", collection)):
        if v and v.strip():
            out = out & F.col(c).eqNullSafe(F.lit(v.strip()))
    return out


def without(chunks: DataFrame, filename: str, unit: str | None = None, collection: str | None = None) -> DataFrame:
    return chunks.where(~F.coalesce(in_scope(filename, unit, collection), F.lit(False)))


def replaced(existing: DataFrame, incoming: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """``existing`` without the rows of the files in ``scopes`` (filename, unit, collection; null: any), and ``incoming``.

    Without ``scopes`` those of ``incoming`` hold. An anti join on the file name, so a batch of files is one pass.
    """
    keys = (incoming if scopes is None else scopes).select("filename", "unit", "collection").distinct()
    e, k = existing.alias("e"), keys.alias("k")
    same = F.col("e.filename") == F.col("k.filename")
    for c in ("unit", "collection"):
        same = same & (F.col(f"k.{c}").isNull() | (F.col(f"k.{c}") == F.col(f"e.{c}")))
    return e.join(k, same, "left_anti").unionByName(incoming, allowMissingColumns=True)


def merged_metadata(own: Column, more: Column) -> Column:
    """Two JSON objects as one; the second one's values win. Values are kept as text."""
    kind = T.MapType(T.StringType(), T.StringType())
    read = lambda c: F.coalesce(F.from_json(c, kind), F.create_map().cast(kind))
    a, b = read(own), read(more)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b))


def log_rows(answers: DataFrame, response_time_ms: Column | None = None, created_at: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Query log rows of ``answers`` (query, answer, sources): texts are cut as the log's columns ask. ``keep``: columns
    that stay."""
    sources = F.col("sources")
    return answers.select(
        *keep, F.substring("query", 1, 1000).alias("query_text"), F.substring(F.substring("answer", 1, 200), 1, 500).alias("answer_preview"),
        (F.lit(0) if response_time_ms is None else response_time_ms).cast("int").alias("response_time_ms"), F.when(sources.isNull(), 0).otherwise(F.size(sources)).alias("chunks_retrieved"),
        F.coalesce(F.try_element_at(sources, F.lit(1))["filename"], F.lit("N/A")).alias("top_source"), F.lit(None).cast("string").alias("user_ip"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def numbered(rows: DataFrame, base: int, column: str = "id") -> DataFrame:
    """Number the rows of a settled table base + 1, base + 2, ... in partition order: two passes, no shuffle."""
    marked = rows.withColumn("_at", F.monotonically_increasing_id())
    sizes = sorted((r["p"], r["n"]) for r in marked.groupBy(F.shiftright("_at", 33).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    before, so_far = {}, base + 1
    for p, n in sizes:
        before[p], so_far = so_far, so_far + n
    if not sizes:
        return marked.withColumn(column, F.lit(None).cast("long")).drop("_at")
    starts = F.array(*[F.lit(before.get(p, 0)).cast("long") for p in range(max(before) + 1)])
    return marked.withColumn(column, F.get(starts, F.shiftright("_at", 33).cast("int")) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


class DocumentStore:
    """Tables below one folder. Every write is one Spark job whose output is committed as a whole."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create_tables(self) -> None:
        """Empty tables where there are none."""
        for name, schema in TABLES.items():
            if not self._exists(self.path(name)):
                empty = self.spark.createDataFrame([], schema)
                self._write(empty, name, "append")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _parted(self, rows: DataFrame) -> DataFrame:
        scoped = rows.withColumns({c: F.coalesce(F.col(c), F.lit(NO_SCOPE)) for c in ("unit", "collection")})
        return scoped.withColumn("bucket", F.pmod(F.xxhash64("filename"), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, name: str, mode: str) -> None:
        if name != "chunks":
            rows.write.mode(mode).parquet(self.path(name))
            return
        parted = self._parted(rows).hint("rebalance", "unit", "collection", "bucket")  # large partitions are split over tasks, small ones share one
        parted.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("unit", "collection", "bucket").parquet(self.path(name))

    def _raw(self) -> DataFrame:
        """The chunk table with its partition columns as stored."""
        schema = T.StructType([*T.StructType.fromDDL(TABLES["chunks"]), T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path("chunks"))

    def table(self, name: str) -> DataFrame:
        return self.chunks() if name == "chunks" else self.spark.read.schema(TABLES[name]).parquet(self.path(name))

    def chunks(self, unit: str | None = None, collection: str | None = None) -> DataFrame:
        """The chunk table; a scope prunes partitions."""
        df = self._raw()
        for c, v in (("unit", unit), ("collection", collection)):
            if v and v.strip():
                df = df.where(F.col(c) == v.strip())
        out = df.withColumns({c: F.nullif(F.col(c), F.lit(NO_SCOPE)) for c in ("unit", "collection")})
        return out.select(*T.StructType.fromDDL(TABLES["chunks"]).names)

    def staged(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """``rows`` written to a table of their own below the store, and its path."""
        path = self.path(f"_staging/{uuid.uuid4().hex}")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path), path

    def discard(self, path: str) -> None:
        """Remove a staged table."""
        self._drop(path)

    def _drop(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _filled(self, rows: DataFrame, name: str = "chunks") -> DataFrame:
        """``rows`` in the table's columns; absent ones are null, the file type and size follow the row."""
        schema, have = T.StructType.fromDDL(TABLES[name]), set(rows.columns)
        out = rows
        if name == "chunks":
            if "file_type" not in have:
                out = out.withColumn("file_type", F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1)))
            if "file_size" not in have:
                out = out.withColumn("file_size", F.octet_length("content"))
            if "created_at" not in have:
                out = out.withColumn("created_at", F.current_timestamp())
            if "content_hash" not in have:
                out = out.withColumn("content_hash", F.sha2(F.col("content"), 256))
        have = set(out.columns)
        return out.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def _next_id(self, name: str) -> int:
        return (self.table(name).agg(F.max("id")).first()[0]) or 0

    def append(self, rows: DataFrame, name: str = "chunks") -> int:
        """Add rows with new ids; returns how many."""
        staged, at = self.staged(self._filled(rows, name))
        count = staged.count()
        if count:
            self._write(numbered(staged.drop("id"), self._next_id(name)).select(*[f.name for f in T.StructType.fromDDL(TABLES[name])]), name, "append")
        self._drop(at)
        return count

    def save_with_metadata(self, rows: DataFrame, metadata: Column) -> int:
        own = F.col("doc_metadata") if "doc_metadata" in rows.columns else F.lit("{}")
        return self.append(rows.withColumn("doc_metadata", merged_metadata(own, metadata)))

    def _rewrite(self, dropped: Column, added: DataFrame | None = None, names: DataFrame | None = None) -> int:
        """Drop rows (of the files in ``names``, if given) and add others in one overwrite of the partitions concerned;
        returns how many rows went."""
        raw, parts, gone = self._raw(), ["unit", "collection", "bucket"], F.coalesce(dropped, F.lit(False))
        old = raw.where(gone) if names is None else raw.where(gone).join(names, "filename", "left_semi")
        hit = {tuple(r[:3]): r["n"] for r in old.groupBy(*parts).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per partition concerned
        touched, staging, new = set(hit), [], None
        if added is not None:
            staged, at = self.staged(self._filled(added))
            staging.append(at)
            new = self._parted(numbered(staged.drop("id"), self._next_id("chunks")))
            touched |= {tuple(r) for r in new.select(*parts).distinct().collect()}
        if not touched:
            return 0
        concerned = F.lit(False)
        for values in sorted(touched):
            concerned = concerned | ((F.col("unit") == values[0]) & (F.col("collection") == values[1]) & (F.col("bucket") == values[2]))
        kept = raw.where(concerned)
        kept = kept.where(~gone) if names is None else kept.where(~gone).unionByName(kept.where(gone).join(names, "filename", "left_anti"))
        whole, at = self.staged(kept if new is None else kept.unionByName(new))
        staging.append(at)
        left = {tuple(r) for r in whole.select(*parts).distinct().collect()}
        self._write(whole.drop("bucket"), "chunks", "overwrite")
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for u, c, b in sorted(touched - left):  # a partition that lost its last row is not overwritten
            self._drop(f"{self.path('chunks')}/unit={escape(u)}/collection={escape(c)}/bucket={b}")
        for at in staging:
            self._drop(at)
        return sum(hit.values())

    def delete(self, key: int) -> bool:
        return self._rewrite(F.col("id") == key) > 0

    def delete_by_filename(self, filename: str, unit: str | None = None, collection: str | None = None) -> int:
        return self._rewrite(in_scope(filename, unit, collection))

    def replace(self, filename: str, rows: DataFrame, unit: str | None = None, collection: str | None = None) -> int:
        """Re-ingest: the file's rows in the scope go, ``rows`` come, in one overwrite. Returns how many went."""
        return self._rewrite(in_scope(filename, unit, collection), rows)

    def replace_all(self, rows: DataFrame, unit: str | None = None, collection: str | None = None, names: DataFrame | None = None) -> int:
        """Re-ingest of a batch of files: the rows in the scope of each file (of ``names``, or else of ``rows``) go, ``rows``
        come, in one overwrite."""
        staged, at = self.staged(rows)
        scope = F.lit(True)
        for c, v in (("unit", unit), ("collection", collection)):
            if v and v.strip():
                scope = scope & (F.col(c) == v.strip())
        removed = self._rewrite(scope, staged, (staged if names is None else names).select("filename").distinct())
        self._drop(at)
        return removed

    def log(self, answers: DataFrame, **options) -> int:
        return self.append(log_rows(answers, **options), "query_logs")
