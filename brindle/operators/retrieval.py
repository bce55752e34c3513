"""From a batch of questions to ranked, cited context and an answer: one lazy plan for any number of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Policy
from ..functions import relevance as R
from .search import search, search_dictionary


def expand(chunks: DataFrame, questions: DataFrame, per_question: int = 3) -> DataFrame:
    """``questions`` with expanded (terms of near glossary chunks in brackets) and headers (theirs)."""
    near = search_dictionary(chunks, questions, per_question)
    both = near.join(questions.select("query_id", "query"), "query_id")
    found = F.regexp_extract_all(F.substring("content", 1, 500), F.lit(rf"[{R.LETTERS}]{{4,}}"), F.lit(0))
    terms = F.filter(F.transform(F.slice(found, 1, 12), F.lower), lambda w: ~F.contains(F.lower("query"), w))
    each = both.select("query_id", "rank", terms.alias("terms"), R.chunk_header(F.col("doc_metadata"), F.col("content")).alias("header"))
    rows = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "terms", "header"))).alias("x"))
    rows = rows.select("query_id", F.slice(F.array_distinct(F.flatten(F.transform("x", lambda r: r["terms"]))), 1, 8).alias("terms"), F.filter(F.transform("x", lambda r: r["header"]), lambda h: h != "").alias("headers"))
    out = questions.join(rows, "query_id", "left")
    bracket = F.concat("query", F.lit(" ("), F.array_join("terms", ", "), F.lit(")"))
    none = F.expr("cast(array() as array<string>)")
    return out.withColumn("expanded", F.when(F.size(F.coalesce("terms", none)) > 0, bracket).otherwise(F.col("query"))).withColumn("headers", F.coalesce("headers", none)).drop("terms")


def with_policies(questions: DataFrame, policies: dict[str, Policy], default: Policy = Policy(), unit_col: str = "unit") -> DataFrame:
    """``questions`` with the policy of each one's unit (a struct column ``policy``). The table of policies is configuration:
    as many rows as there are names in ``policies``, so it is broadcast."""
    names = ("candidate_multiplier", "min_similarity", "numeric_weight", "overlap_weight", "header_weight", "max_context_chunks")
    kinds = ("int", "double", "double", "double", "double", "int")
    schema = "_unit string, _policy struct<" + ", ".join(f"{n}:{k}" for n, k in zip(names, kinds)) + ">"
    rows = [(unit.strip().lower(), tuple(getattr(p, n) for n in names)) for unit, p in policies.items()]
    table = questions.sparkSession.createDataFrame(rows, schema)
    own = F.struct(*[F.lit(getattr(default, n)).cast(k).alias(n) for n, k in zip(names, kinds)])
    joined = questions.join(F.broadcast(table), F.lower(F.trim(F.coalesce(unit_col, F.lit("")))) == F.col("_unit"), "left")
    return joined.withColumn("policy", F.coalesce("_policy", own)).drop("_unit", "_policy")


def _setting(rows: DataFrame, policy: Policy, name: str):
    """A policy's value: each row's own where it has a policy, else that of the call."""
    return F.col("policy")[name] if "policy" in rows.columns else F.lit(getattr(policy, name))


def rerank(candidates: DataFrame, k: int, policy: Policy = Policy()) -> DataFrame:
    """Candidates (with query, similarity, content, doc_metadata, headers) in their final order, cut at k."""
    header = R.chunk_header(F.col("doc_metadata"), F.col("content"))
    number = F.when(R.wants_numbers(F.col("query")), R.numericity(F.col("content"))).otherwise(F.lit(0.0))
    of = lambda name: _setting(candidates, policy, name)
    score = F.coalesce("similarity", F.lit(0.0)) + of("numeric_weight") * number + of("overlap_weight") * R.token_overlap(F.col("query"), F.col("content")) + of("header_weight") * R.header_similarity(header, F.col("headers"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("similarity"), "id")
    scored = candidates.withColumn("score", F.round(score, 6)).drop("rank")
    most = F.coalesce(_setting(candidates, Policy(), "max_context_chunks").cast("int"), F.lit(k))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def context(ranked: DataFrame) -> DataFrame:
    """Per question the context text and its sources, in rank order. A question's rows are at most k."""
    pages = R.source_pages(F.col("doc_metadata"), F.col("content"))
    header = R.sanitize_header(R.chunk_header(F.col("doc_metadata"), F.col("content")))
    rows = ranked.withColumn("pages", pages).withColumn("shown", header)
    label = F.concat(
        F.lit("[Kaynak "), F.col("rank").cast("string"), F.lit(": "), "filename",
        F.when(F.col("pages").isNotNull(), F.concat(F.lit(" | Sayfa: "), "pages")).otherwise(""),
        F.when(F.col("shown").isNotNull(), F.concat(F.lit(" | Bölüm: "), "shown")).otherwise(""),
        F.lit(" | Benzerlik: %"), R.percent(F.col("similarity")).cast("string"), F.lit("]\n"), F.coalesce("content", F.lit("")),
    )
    source = F.struct(
        "rank", "id", "filename", "chunk_index", F.col("shown").alias("header"), F.least(F.lit(1.0), "similarity").alias("similarity"),
        F.substring("content", 1, 300).alias("preview"), F.length("content").alias("chunk_size"), F.col("pages").alias("source_pages"), "unit", "collection",
    )
    both = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", label.alias("part"), source.alias("source")))).alias("x"))
    return both.select("query_id", F.array_join(F.transform("x", lambda r: r["part"]), "\n\n---\n\n").alias("context"), F.transform("x", lambda r: r["source"]).alias("sources"))


def debug_info(candidates: DataFrame, ranked: DataFrame, k: int, policy: Policy = Policy(), unit: str | None = None, collection: str | None = None, filenames: list[str] | None = None, **_) -> DataFrame:
    """query_id, debug_info: how the retrieval went, with the first three chunks."""
    counts = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct(F.col("rank").cast("int").alias("rank"), "filename", "chunk_index", F.round("similarity", 4).alias("similarity_score"))
    top = ranked.where(F.col("rank") <= 3).groupBy("query_id").agg(F.array_sort(F.collect_list(first)).alias("top"))
    info = F.struct(
        F.lit("SCOPED" if (filenames or unit or collection) else "GLOBAL").alias("retrieval_mode"), F.lit(unit).cast("string").alias("unit"), F.lit(collection).cast("string").alias("collection"),
        F.array(*map(F.lit, filenames or [])).cast("array<string>").alias("filename_filters"), F.lit(max(k, 1) * max(policy.candidate_multiplier, 1)).alias("candidate_k"),
        F.col("n").alias("candidate_count"), "top",
    )
    return counts.join(top, "query_id", "left").select("query_id", info.alias("debug_info"))


def candidates(chunks: DataFrame, questions: DataFrame, k: int, policy: Policy = Policy(), widest: int | None = None, **scope) -> DataFrame:
    """Over-fetched chunks of each question that are near enough, with the question's text and headers. Questions may have
    policies of their own (``with_policies``); ``widest`` is then the largest of their multipliers."""
    found = search(chunks, questions, max(k, 1) * max(widest or policy.candidate_multiplier, 1), **scope)
    headers = F.col("headers") if "headers" in questions.columns else F.expr("cast(array() as array<string>)").alias("headers")
    asked = questions.select("query_id", "query", headers, *(["policy"] if "policy" in questions.columns else []))
    both = found.join(asked, "query_id").where(F.coalesce("similarity", F.lit(0.0)) >= _setting(asked, policy, "min_similarity"))
    if "policy" in asked.columns:
        both = both.where(F.col("rank") <= max(k, 1) * F.greatest(F.col("policy")["candidate_multiplier"], F.lit(1)))
    return both


def retrieve(chunks: DataFrame, questions: DataFrame, k: int, policy: Policy = Policy(), **scope) -> DataFrame:
    """Over-fetch, drop what is too far, rerank. ``questions``: query_id, query, qv [, headers]."""
    return rerank(candidates(chunks, questions, k, policy, **scope), policy.max_context_chunks or k, policy)


def retrieve_by_unit(chunks: DataFrame, questions: DataFrame, k: int, policies: dict[str, Policy], default: Policy = Policy()) -> DataFrame:
    """``retrieve`` for questions of several units (column ``unit``) at once, each by its unit's policy."""
    widest = max(p.candidate_multiplier for p in (default, *policies.values()))
    near = candidates(chunks, with_policies(questions, policies, default), k, default, widest)
    return rerank(near, k, default)


def answer(chunks: DataFrame, questions: DataFrame, k: int, embed, generate, policy: Policy = Policy(), custom_prompt: str | None = None, **scope) -> DataFrame:
    """The whole way: embed, expand, embed anew, retrieve, build the context, generate. ``embed`` and ``generate`` are
    column functions (text -> vector; system prompt, user prompt -> text). Questions without a source get the fallback."""
    asked = questions.withColumn("qv", embed(F.col("query")))
    if policy.expand:
        asked = expand(chunks, asked)
        asked = asked.withColumn("qv", F.when(F.col("expanded") == F.col("query"), F.col("qv")).otherwise(embed(F.col("expanded"))))
    near = candidates(chunks, asked, k, policy, **scope)
    ranked = rerank(near, policy.max_context_chunks or k, policy)
    out = asked.select("query_id", "query").join(context(ranked), "query_id", "left").join(debug_info(near, ranked, k, policy, **scope), "query_id", "left")
    made = generate(R.system_prompt(F.lit(custom_prompt)), R.user_prompt(F.col("query"), F.col("context")))
    return out.select("query_id", "query", F.when(F.col("context").isNull(), F.lit(policy.fallback_answer)).otherwise(F.trim(made)).alias("answer"), "sources", F.lit("SCOPED" if any(scope.values()) else "GLOBAL").alias("mode"), "debug_info")


def frames(answers: DataFrame) -> DataFrame:
    """Server-sent event frames of each answer: the answer, its sources if it has any, how it was found."""
    shown = F.transform("sources", lambda s: F.struct(s["filename"].alias("filename"), s["chunk_index"].alias("chunk_index"), s["header"].alias("header"), s["similarity"].alias("similarity_score"), s["preview"].alias("content_preview"), s["source_pages"].alias("source_pages")))
    options = {"ignoreNullFields": "false"}
    events = F.filter(
        F.array(
            F.struct(F.lit("answer").alias("event"), F.to_json(F.struct("answer"), options).alias("payload")),
            F.struct(F.lit("sources").alias("event"), F.when(F.size("sources") > 0, F.to_json(F.struct(shown.alias("sources")), options)).alias("payload")),
            F.struct(F.lit("debug_info").alias("event"), F.when(F.col("debug_info").isNotNull(), F.to_json(F.struct("debug_info"), options)).alias("payload")),
        ),
        lambda e: e["payload"].isNotNull(),
    )
    return answers.select("query_id", F.posexplode(events).alias("seq", "e")).select("query_id", "seq", "e.event", F.concat(F.lit("data: "), "e.payload", F.lit("\n\n")).alias("frame"))


def banner(answers: DataFrame) -> DataFrame:
    """Each answer as a plain text stream: its sources as lines, a rule, the answer; the answer alone where it has none."""
    line = lambda s: F.concat(
        F.lit("  • "), s["filename"], F.when(s["source_pages"].isNotNull(), F.concat(F.lit(" | Sayfa "), s["source_pages"])).otherwise(""),
        F.when(s["header"].isNotNull(), F.concat(F.lit(" - "), s["header"])).otherwise(""), F.lit(" (Güven: %"), R.percent(s["similarity"]).cast("string"), F.lit(")\n"),
    )
    head = F.concat(F.lit("📚 KAYNAKLAR ("), F.size("sources").cast("string"), F.lit(" chunk):\n"), F.array_join(F.transform("sources", line), ""), F.lit("\n" + "=" * 70 + "\n\n"))
    return answers.select("query_id", F.when(F.size("sources") > 0, F.concat(head, "answer")).otherwise(F.col("answer")).alias("stream"))
