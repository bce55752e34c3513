"""Exact, filtered vector top-k for batches of questions.

Questions come to the executors in blocks of bounded size; chunks meet them in matrix products of bounded size, and a task
hands on its own top k per question, so what is held and shuffled does not grow with the corpus. Filters are plain predicates that
reach the scan (unit and collection are partition columns of the store).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.relevance import cosine

#: Questions that are shared with the executors at once.
BLOCK = 1024
#: Similarities that a task holds at once (8 bytes each, and some copies of them).
CELLS = 1 << 19
#: Found rows (of some 40 bytes) that may be broadcast to fetch their chunks; with more, both sides are shuffled.
MOST_SHARED = 200_000


def not_deleted() -> Column:
    return F.col("deleted_at").isNull()


def names_dictionary() -> Column:
    low = F.lower("filename")
    return low.like("%sozluk%") | low.like("%sözlük%") | low.like("%dictionary%")


def marked_dictionary() -> Column:
    return F.get_json_object("doc_metadata", "$.is_dictionary").eqNullSafe("true")


def only_dictionary() -> Column:
    return marked_dictionary() | names_dictionary()


def no_dictionary() -> Column:
    return ~marked_dictionary() & ~names_dictionary()


def scoped(chunks: DataFrame, unit: str | None = None, collection: str | None = None, filenames: list[str] | None = None, filename: str | None = None, doc_type: str | None = None) -> DataFrame:
    """Blank scopes count as absent; file names win over a single one, and both over the document type."""
    from ..schema import scope_filenames

    for c, v in (("unit", unit), ("collection", collection)):
        if v and v.strip():
            chunks = chunks.where(F.col(c) == v.strip())
    names = scope_filenames(filenames, filename)
    if names:
        return chunks.where(F.col("filename").isin(names) if len(names) > 1 else F.col("filename") == names[0])
    if doc_type and doc_type.strip():
        return chunks.where(F.get_json_object("doc_metadata", "$.doc_type") == doc_type.strip())
    return chunks


def in_scopes(chunks: DataFrame, scopes: DataFrame) -> DataFrame:
    """Chunks of the files in ``scopes`` (filename): a left semi join."""
    return chunks.join(scopes.select("filename").distinct(), "filename", "left_semi")


def _near(keys: np.ndarray, sim: np.ndarray, k: int, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What may be among the k best of each question (a column of ``sim``): a partition finds each column's k-th value; what
    reaches it, and the k-th value ``low`` of the rows before, is kept."""
    s = np.where(np.isnan(sim), -np.inf, sim)
    bound = np.maximum(low, np.partition(s, len(s) - k, axis=0)[len(s) - k]) if k < len(s) else low
    row, column = np.nonzero((s >= bound) & np.isfinite(s))
    return column, keys[row], s[row, column]


def _first(column: np.ndarray, keys: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each question's rows, ties to the lower key: question, key, similarity."""
    order = np.lexsort((keys, -sim, column))
    column, keys, sim = column[order], keys[order], sim[order]
    keep = np.arange(len(column)) - np.searchsorted(column, column) < k
    return column[keep], keys[keep], sim[keep]


def top_k(chunks: DataFrame, questions: DataFrame, k: int, vector: str = "embedding", key: str = "id", id_col: str = "query_id", question_vector: str = "qv") -> DataFrame:
    """Each question's k nearest chunks: query_id, rank, similarity, distance, and the chunk's columns without its vector.

    Rows without a vector are left out. Similarities are rounded to 9 digits, then ties go to the lower key.
    """
    spark = chunks.sparkSession
    asked = questions.select(F.col(id_col).cast("long").alias("q"), F.col(question_vector).alias("v")).where("v is not null")
    found = None
    first = asked.limit(BLOCK + 1).collect()
    count = len(first) if len(first) <= BLOCK else asked.count()
    for block in range(max(1, -(-count // BLOCK))):
        rows = first if count <= BLOCK else asked.where(F.pmod(F.xxhash64("q"), F.lit(-(-count // BLOCK))) == block).collect()
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)))

        def run(batches, shared=shared):
            ids, q = shared.value
            if not ids:
                return
            norm, rows = np.linalg.norm(q, axis=1), max(1, CELLS // len(ids))
            low, parts = np.full(len(ids), -np.inf), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for b in (whole.slice(i, rows) for whole in batches for i in range(0, whole.num_rows, rows)):
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    sim = np.round((x @ q.T) / (np.linalg.norm(x, axis=1)[:, None] * norm), 9)
                parts.append(_near(b.column(0).to_numpy(zero_copy_only=False), sim, k, low))
                if sum(len(p[0]) for p in parts[1:]) >= k * len(ids):
                    parts = [_first(*map(np.concatenate, zip(*parts)), k)]
                    column, _, found_ = parts[0]
                    full = np.bincount(column, minlength=len(ids)) == k
                    low = np.where(full, found_[np.searchsorted(column, np.arange(len(ids)), side="right") - 1], -np.inf) if len(column) else low
            column, keys, best = _first(*map(np.concatenate, zip(*parts)), k)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ids, np.int64)[column]), pa.array(keys), pa.array(best)], ["query_id", "key", "similarity"])

        near = chunks.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(run, "query_id long, key long, similarity double")
        found = near if found is None else found.unionByName(near)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if count * k <= MOST_SHARED:  # k rows a question: the chunks are read where they lie
        best = F.broadcast(best)
    return best.join(chunks.drop(vector), F.col("key") == F.col(key)).drop("key").withColumn("distance", 1 - F.col("similarity"))


def top_k_native(chunks: DataFrame, vector_literal: list[float], k: int, vector: str = "embedding", key: str = "id") -> DataFrame:
    """One question as expressions alone: a projection and TakeOrderedAndProject."""
    q = F.array(*[F.lit(float(x)) for x in vector_literal])
    out = chunks.where(F.col(vector).isNotNull()).withColumn("similarity", F.round(cosine(F.col(vector), q), 9)).drop(vector)
    return out.orderBy(F.desc_nulls_last("similarity"), key).limit(k)


def search(chunks: DataFrame, questions: DataFrame, k: int, **scope) -> DataFrame:
    return top_k(scoped(chunks.where(not_deleted() & no_dictionary()), **scope), questions, k)


def search_dictionary(chunks: DataFrame, questions: DataFrame, k: int = 3) -> DataFrame:
    return top_k(chunks.where(not_deleted() & only_dictionary()), questions, k)
