"""The engine's surface: what the service's endpoints do, as calls that give DataFrames."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .config import Policy, Settings, policy_for
from .functions.models import embedder, first_sentence, hash_vectors
from .operators import analytics, retrieval
from .pipeline import ask, ingest
from .sinks.store import DocumentStore
from .sources.files import PdfReader, binary_files, extracted, uploads


def key_hash(key: str | None) -> str | None:
    """What is kept of an API key."""
    return None if key is None else hashlib.sha256(key.encode()).hexdigest()


def user_of(header: str | None = None, param: str | None = None) -> str:
    return header or param or "anonymous"


def request_id(header: str | None = None) -> str:
    return header or str(uuid.uuid4())


class Engine:
    """A document store with models attached. ``embed`` and ``generate`` are column functions; stand-ins by default."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, embed=None, generate=None, pdf: PdfReader | None = None, policies: dict[str, Policy] | None = None):
        self.settings = settings or Settings()
        dim = self.settings.embedding_dim
        self.spark, self.store = spark, DocumentStore(spark, root)
        self.embed = embed or embedder(lambda texts: hash_vectors(texts, dim), self.settings.embedding_batch)
        self.generate, self.pdf, self.policies = generate or first_sentence, pdf, policies
        self.store.create_tables()

    def ingest(self, path: str, unit: str | None = None, collection: str | None = None) -> DataFrame:
        """Read the files below ``path``, replace what the store has of them, and tell how it went, file by file."""
        files, at = self.store.staged(extracted(binary_files(self.spark, path), self.pdf))
        rows, _ = self.store.staged(ingest(files.where("error is null"), self.embed, self.settings.chunk_size))
        scoped = rows.withColumns({"unit": F.lit(unit).cast("string"), "collection": F.lit(collection).cast("string")})
        self.store.replace_all(scoped, unit, collection, files.where("error is null").select("filename"))
        return analytics.ingestion_summary(files, rows)

    def ingest_with_metadata(self, path: str, upload_date: str | None = None, pages: str | None = None) -> int:
        """Store each file below ``path`` as one row without a vector."""
        date = None if upload_date is None else F.lit(upload_date)
        rows = uploads(binary_files(self.spark, path), date, None if pages is None else F.lit(pages), self.pdf)
        return self.store.append(rows)

    def query_scoped(self, questions: DataFrame, top_k: int = 10, filenames: list[str] | None = None, unit: str | None = None, collection: str | None = None, system_prompt: str | None = None) -> DataFrame:
        schema.check_scope(filenames, unit, collection)
        if not 1 <= top_k <= 20:
            raise ValueError("top_k is 1 to 20")
        asked = questions.where(F.length("query").between(1, 5000))
        chunks = self.store.chunks(unit, collection)
        return ask(chunks, asked, top_k, self.embed, self.generate, self.store, policy_for(unit, self.policies), system_prompt, filenames=filenames, unit=unit, collection=collection)

    def query_one(self, query: str, top_k: int = 10, temperature: float = 0.0, **scope) -> DataFrame:
        schema.check_question(query, top_k, temperature)
        return self.query_scoped(self.spark.createDataFrame([(0, query)], "query_id long, query string"), top_k, **scope)

    def query_stream(self, questions: DataFrame, top_k: int = 10, filenames: list[str] | None = None) -> DataFrame:
        """The answers as event frames, in order."""
        return retrieval.frames(ask(self.store.chunks(), questions, top_k, self.embed, self.generate, self.store, policy_for(None, self.policies), filenames=filenames))

    def documents(self) -> DataFrame:
        return analytics.document_list(self.store.chunks())

    def count(self) -> DataFrame:
        return analytics.count_chunks(self.store.chunks())

    def analytics(self, today: str | None = None) -> DataFrame:
        return analytics.dashboard(self.store.chunks(), self.store.table("query_logs"), today)

    def system_info(self) -> DataFrame:
        return analytics.system_info(self.store.chunks(), self.settings.embedding_dim)

    def delete_by_filename(self, filename: str, unit: str | None = None, collection: str | None = None) -> int:
        removed = self.store.delete_by_filename(filename, unit, collection)
        if not removed:
            raise KeyError(f"no chunk of {filename} is stored")
        return removed

    def health(self) -> str:
        def works(f) -> bool:
            try:
                return f() is not None
            except Exception:
                return False

        one = self.spark.range(1).select(F.lit("probe").alias("t"))
        return analytics.health({"store": works(lambda: self.count().first()), "embedding": works(lambda: one.select(self.embed(F.col("t"))).first()), "text": works(lambda: one.select(self.generate(F.col("t"), F.col("t"))).first())})
