"""The two composite ways: files to stored chunks, and questions to logged answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import Policy
from .functions import classify, normalize
from .operators import chunking, enrich, retrieval
from .operators.layout import by_slices

PIECE = T.ArrayType(T.StructType([*chunking.FIELDS, T.StructField("page", T.IntegerType())]))


def chunks_with_pages(text: str | None, size: int = chunking.SIZE) -> list[dict]:
    """The router's chunks, each with the page that it starts on."""
    text = text or ""
    marks = [(m.start(), int(m[1])) for m in enrich.PAGE.finditer(text)]
    return [c | {"page": enrich.page_of(text, marks, c["content"])} for c in chunking.route(text, size)]


def ingest(files: DataFrame, embed=None, size: int = chunking.SIZE) -> DataFrame:
    """Chunk rows of extracted files (filename, text, html_format): filename, chunk_index, content, embedding, doc_metadata.

    A document's text stays in its row until it is cut, and nothing is shuffled. ``embed`` is a column function.
    """
    cut = by_slices(lambda t: chunks_with_pages(t, size), PIECE)
    kind = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    layout = F.col("html_format") if "html_format" in files.columns else F.lit(None).cast("string")
    plain = normalize.clean_text(normalize.to_markdown(F.col("text")))
    ready = F.when(kind.isin(".html", ".htm", ".md"), normalize.clean_text(F.col("text"))).otherwise(plain)
    docs = files.where("text is not null").select(
        "filename", F.length("text").alias("_length"), enrich.doc_label(F.col("filename")).alias("_label"),
        classify.document_type(F.col("filename"), F.col("text"), layout).alias("_kind"), classify.is_dictionary(F.col("filename"), F.col("text")).alias("_dictionary"), cut.asNondeterministic()(ready).alias("_chunks"),
    )
    each = docs.select("*", F.posexplode("_chunks").alias("chunk_index", "c")).drop("_chunks")
    content = enrich.prefixed(F.col("_label"), F.col("_kind"), F.col("c.header"), F.col("c.content"))
    rows = each.withColumn("content", content)
    meta = enrich.metadata(F.col("filename"), F.col("content"), F.col("_length"), F.col("c.header"), F.col("c.position"), F.col("_kind"), F.col("_dictionary"), F.col("c.page"))
    vector = F.lit(None).cast("array<float>") if embed is None else embed(F.col("content"))
    return rows.select("filename", "chunk_index", "content", vector.alias("embedding"), meta.alias("doc_metadata"))


def ask(chunks: DataFrame, questions: DataFrame, k: int, embed, generate, store=None, policy: Policy = Policy(), custom_prompt: str | None = None, **scope) -> DataFrame:
    """Answers of ``questions`` (query_id, query); with a store they are settled and logged, and read back."""
    answers = retrieval.answer(chunks, questions, k, embed, generate, policy, custom_prompt, **scope)
    if store is None:
        return answers
    settled, _ = store.staged(answers)
    store.log(settled)
    return settled
