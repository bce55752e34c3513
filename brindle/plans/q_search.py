"""Queries over the corpus: filters, vector search, reranking, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Policy
from ..functions import relevance as R
from ..functions.models import LETTERS, embedder, first_sentence, hash_vectors, letter_counts
from ..operators import retrieval, search
from .views import CORPUS, corpus, documents, questions, questions_sql, settled, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_NODICT = "embedding is not null and deleted_at is null and not is_dictionary and lower(filename) not like '%sozluk%' and lower(filename) not like '%sözlük%' and lower(filename) not like '%dictionary%'"
_DICT = "embedding is not null and deleted_at is null and (is_dictionary or lower(filename) like '%sozluk%' or lower(filename) like '%sözlük%' or lower(filename) like '%dictionary%')"
_SIM = "round(list_cosine_similarity(c.embedding, q.qv), 9)"


def _top(where: str, k: int, extra: str = "") -> str:
    return f"""with {CORPUS}, {questions_sql()}, near as (select q.query_id, c.id, c.filename, c.chunk_index, {_SIM} as s, row_number() over (partition by q.query_id order by {_SIM} desc, c.id) as r
 from corpus c cross join questions q where {where}) select query_id, id, filename, chunk_index, cast(r as integer) as rank, round(s, 6) as similarity from near where r <= {k} {extra}"""


def _show(df):
    return df.select("query_id", "id", "filename", "chunk_index", F.col("rank").cast("int").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query(_top(_NODICT, 10))
def vector_topk(spark, d):
    return _show(search.search(corpus(spark, d), questions(spark, d), 10))


@query(_top(_NODICT + " and unit = 'en' and collection = 'c1'", 10))
def vector_topk_unit_collection(spark, d):
    return _show(search.search(corpus(spark, d), questions(spark, d), 10, unit=" en ", collection="c1"))


@query(_top(_NODICT + " and filename in ('src1.txt', 'src2.txt')", 10))
def vector_topk_filenames(spark, d):
    return _show(search.search(corpus(spark, d), questions(spark, d), 10, filenames=["src1.txt", " ", "src2.txt "]))


@query(_top(_NODICT + " and doc_type = 't1'", 10))
def vector_topk_doctype(spark, d):
    return _show(search.search(corpus(spark, d), questions(spark, d), 10, doc_type="t1"))


@query(_top(_DICT, 3))
def dictionary_topk(spark, d):
    return _show(search.search_dictionary(corpus(spark, d), questions(spark, d)))


@query(_top(_NODICT, 10))
def batch_topk(spark, d):
    return _show(search.search(corpus(spark, d), questions(spark, d), 10))


@query(_top(_NODICT + " and q.query_id = 0", 10))
def vector_topk_native(spark, d):
    """The expression twin of ``vector_topk``, for one question (the vector of number 0)."""
    qv = questions(spark, d).where("query_id = 0").first()["qv"]
    chunks = corpus(spark, d).where(search.not_deleted() & search.no_dictionary())
    best = search.top_k_native(chunks, qv, 10)
    rank = F.row_number().over(search.Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return _show(best.withColumn("query_id", F.lit(0).cast("long")).withColumn("rank", rank))


@query(_top(_NODICT, 60, "and s >= 0.1"))
def candidate_overfetch_filter(spark, d):
    return _show(search.search(corpus(spark, d), questions(spark, d), 60).where("similarity >= 0.1"))


@query(f"with {CORPUS} select id, filename from corpus where filename in (select distinct o.source || '.txt' from documents o where o.doc_id % 10 = 3)")
def scope_semi_join(spark, d):
    scopes = table(spark, d, "documents").where("doc_id % 10 = 3").select(F.concat("source", F.lit(".txt")).alias("filename"))
    return search.in_scopes(corpus(spark, d), scopes).select("id", "filename")


def _pairs(spark, d):
    """Each document with one of the questions."""
    q = F.element_at(F.array(*[F.lit(x) for x in _questions()]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", "text", q.alias("query"))


def _questions():
    from .views import QUESTIONS

    return QUESTIONS


_PAIRS = "pairs as (select doc_id, text, ([" + ", ".join(f"'{x}'" for x in _questions()) + "])[doc_id % 5 + 1] as query from documents)"
_NUMBER = r"least(1.0, 10.0 * (length({c}) - length(regexp_replace({c}, '[0-9][0-9.,]+', '', 'g'))) / greatest(length({c}), 1))"
_TOKENS = f"list_distinct(regexp_extract_all(lower({{q}}), '[{R.LETTERS}]{{{{3,}}}}'))"
_OVERLAP = f"coalesce(cast(len(list_filter({_TOKENS}, lambda t: contains(lower({{c}}), t))) as double) / nullif(len({_TOKENS}), 0), 0.0)"
_WANTS = "(" + " or ".join(f"contains(lower({{q}}), '{w}')" for w in R.NUMBER_WORDS) + ")"


@query(f"select doc_id, round({_NUMBER.format(c='text')}, 9) as numericity from documents")
def numericity(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(R.numericity(F.col("text")), 9).alias("numericity"))


@query(f"with {_PAIRS} select doc_id, round({_OVERLAP.format(q='query', c='text')}, 9) as overlap from pairs")
def token_overlap(spark, d):
    return _pairs(spark, d).select("doc_id", F.round(R.token_overlap(F.col("query"), F.col("text")), 9).alias("overlap"))


@query(f"select conv_id, turn, {_WANTS.format(q='text')} as wants from conversations")
def wants_numbers(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", R.wants_numbers(F.col("text")).alias("wants"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''))"
_HSIM = (
    "case when {h} = '' or {t} = '' then 0.0 when {h} = {t} then 1.0 when contains({t}, {h}) or contains({h}, {t}) then 0.7 "
    "else coalesce(cast(len(list_intersect(" + _WORDS.format(x="{h}") + ", " + _WORDS.format(x="{t}") + ")) as double) / nullif(len(list_distinct(list_concat(" + _WORDS.format(x="{h}") + ", " + _WORDS.format(x="{t}") + "))), 0), 0.0) end"
)


@query(f"with {CORPUS} select id, round(greatest({_HSIM.format(h='lower(header)', t=chr(39) + 'limit risk' + chr(39))}, {_HSIM.format(h='lower(header)', t=chr(39) + 'note of sayfa' + chr(39))}), 9) as similarity from corpus")
def header_similarity(spark, d):
    targets = F.array(F.lit("Limit Risk"), F.lit("Note of Sayfa"))
    return corpus(spark, d).select("id", F.round(R.header_similarity(F.get_json_object("doc_metadata", "$.header"), targets), 9).alias("similarity"))


_CHUNK_HEADER = "case when c.header <> '' then trim(c.header) else coalesce(regexp_extract(trim(c.content, E' \\n\\t\\r'), '^#{{1,4}}\\s+([^\\n]+)', 1), '') end"
_CHUNK_HEADER = _CHUNK_HEADER.replace("{{", "{").replace("}}", "}")


@query(
    f"""with {CORPUS}, {questions_sql()}, near as (select q.query_id, q.query, c.*, {_SIM} as s, row_number() over (partition by q.query_id order by {_SIM} desc, c.id) as r from corpus c cross join questions q where {_NODICT}),
 scored as (select query_id, id, s, round(s + 0.12 * (case when {_WANTS.format(q='query')} then {_NUMBER.format(c='content')} else 0.0 end) + 0.10 * {_OVERLAP.format(q='query', c='content')}, 6) as score from near where r <= 60 and s >= 0)
 select query_id, id, cast(row_number() over (partition by query_id order by score desc, s desc, id) as integer) as rank, score from scored qualify row_number() over (partition by query_id order by score desc, s desc, id) <= 10"""
)
def rerank_topk(spark, d):
    out = retrieval.retrieve(corpus(spark, d), questions(spark, d), 10)
    return out.select("query_id", "id", F.col("rank").cast("int").alias("rank"), "score")


_POLICIES = {"En": Policy(candidate_multiplier=3, numeric_weight=0.5, overlap_weight=0.3), "fr": Policy(min_similarity=0.2, overlap_weight=0.0, max_context_chunks=4)}


def _by_unit(name: str) -> str:
    return f"case u when 'en' then {getattr(_POLICIES['En'], name)} when 'fr' then {getattr(_POLICIES['fr'], name)} else {getattr(Policy(), name)} end"


@query(
    f"""with {CORPUS}, {questions_sql()}, asked as (select *, ['en', 'fr', 'de'][(query_id // 100) % 3 + 1] as u from questions),
 near as (select q.query_id, q.query, q.u, c.*, {_SIM} as s, row_number() over (partition by q.query_id order by {_SIM} desc, c.id) as r from corpus c cross join asked q where {_NODICT}),
 scored as (select query_id, u, id, s, round(s + {_by_unit("numeric_weight")} * (case when {_WANTS.format(q='query')} then {_NUMBER.format(c='content')} else 0.0 end) + {_by_unit("overlap_weight")} * {_OVERLAP.format(q='query', c='content')}, 6) as score
  from near where r <= 10 * {_by_unit("candidate_multiplier")} and s >= {_by_unit("min_similarity")})
 select query_id, id, cast(row_number() over (partition by query_id order by score desc, s desc, id) as integer) as rank, score from scored
 qualify row_number() over (partition by query_id order by score desc, s desc, id) <= case u when 'fr' then 4 else 10 end"""
)
def rerank_by_unit(spark, d):
    """Questions of three units in one batch, two of which have policies of their own."""
    unit = F.element_at(F.array(F.lit(" EN"), F.lit("fr"), F.lit("de")), (F.floor(F.col("query_id") / 100) % 3 + 1).cast("int"))
    out = retrieval.retrieve_by_unit(corpus(spark, d), questions(spark, d).withColumn("unit", unit), 10, _POLICIES)
    return out.select("query_id", "id", F.col("rank").cast("int").alias("rank"), "score")


_EXPANSION = f"""with {CORPUS}, {questions_sql()}, near as (select q.query_id, q.query, c.id, c.content, {_CHUNK_HEADER} as h, row_number() over (partition by q.query_id order by {_SIM} desc, c.id) as r from corpus c cross join questions q where {_DICT}),
 top as (select * from near where r <= 3), words as (select query_id, query, r, unnest(list_slice(regexp_extract_all(left(content, 500), '[{R.LETTERS}]{{4,}}'), 1, 12)) as w, generate_subscripts(list_slice(regexp_extract_all(left(content, 500), '[{R.LETTERS}]{{4,}}'), 1, 12), 1) as i from top),
 firsts as (select query_id, query, lower(w) as w, min(r * 100 + i) as place from words where not contains(lower(query), lower(w)) group by all),
 eight as (select query_id, query, w, place from firsts qualify row_number() over (partition by query_id order by place) <= 8)
 select q.query_id, case when e.terms is null then q.query else q.query || ' (' || e.terms || ')' end as expanded, coalesce(h.headers, '') as headers from questions q
 left join (select query_id, string_agg(w, ', ' order by place) as terms from eight group by 1) e using (query_id) left join (select query_id, string_agg(h, '|' order by r) as headers from top where h <> '' group by 1) h using (query_id)"""


@query(_EXPANSION)
def dictionary_expansion(spark, d):
    return retrieval.expand(corpus(spark, d), questions(spark, d)).select("query_id", "expanded", F.array_join("headers", "|").alias("headers"))


_SANE = "nullif(list_aggregate(list_filter(list_transform(string_split({h}, ' > '), lambda p: trim(p)), lambda p: p <> '' and not regexp_matches(p, '(?i)^(sayfa\\s+[0-9]+|genel doküman)$') and length(p) <= 90 and not regexp_matches(p, '[.;:]$')), 'string_agg', ' > '), '')"


@query(f"with {CORPUS} select id, {_SANE.format(h='header')} as shown from corpus")
def sanitize_header(spark, d):
    return corpus(spark, d).select("id", R.sanitize_header(F.get_json_object("doc_metadata", "$.header")).alias("shown"))


_PAGES = "list_transform(regexp_extract_all({c}, '(?m)^#+\\s*Sayfa\\s+([0-9]+)\\s*$', 1), lambda x: cast(x as integer))"


@query(f"with {CORPUS}, marked as (select *, '## Sayfa ' || (id % 4 + 1) || chr(10) || content || chr(10) || '## Sayfa ' || (id % 9 + 1) as c from corpus) select id, coalesce(source_page, case when list_min({_PAGES.format(c='c')}) = list_max({_PAGES.format(c='c')}) then cast(list_min({_PAGES.format(c='c')}) as varchar) else list_min({_PAGES.format(c='c')}) || '-' || list_max({_PAGES.format(c='c')}) end) as pages from marked")
def source_pages(spark, d):
    c = F.concat(F.lit("## Sayfa "), (F.col("id") % 4 + 1).cast("string"), F.lit("\n"), "content", F.lit("\n## Sayfa "), (F.col("id") % 9 + 1).cast("string"))
    return corpus(spark, d).select("id", R.source_pages(F.col("doc_metadata"), c).alias("pages"))


@query(
    f"""with {CORPUS}, {questions_sql()}, near as (select q.query_id, c.*, {_SIM} as s, row_number() over (partition by q.query_id order by {_SIM} desc, c.id) as r from corpus c cross join questions q where {_NODICT}),
 top as (select *, {_SANE.format(h='header')} as shown from near where r <= 5)
 select query_id, string_agg('[Kaynak ' || r || ': ' || filename || case when source_page is null then '' else ' | Sayfa: ' || source_page end || case when shown is null then '' else ' | Bölüm: ' || shown end || ' | Benzerlik: %' || cast(round_even(s * 100, 0) as integer) || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by r) as context, count(*) as n_sources from top group by 1"""
)
def context_sources(spark, d):
    found = search.search(corpus(spark, d), questions(spark, d), 5)
    return retrieval.context(found).select("query_id", "context", F.size("sources").cast("long").alias("n_sources"))


@query()
def hash_embed(spark, d):
    """Deterministic stand-in vectors, with their unit length checked."""
    v = documents(spark, d).select("doc_id", embedder(hash_vectors)(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("norm"))


def _letters(x: str) -> str:
    return "[" + ", ".join(f"cast(length({x}) - length(replace({x}, '{c}', '')) as double)" for c in LETTERS) + "]"


def _cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}, {b}), 9)"


_LIVE = _NODICT.replace("embedding is not null and ", "")
_KNOWN = _DICT.replace("embedding is not null and ", "")
_SHOWN = _SANE.format(h="h")
_SENTENCE = r"regexp_extract('KONTEXT:' || chr(10) || context || chr(10) || chr(10) || 'SORU: ' || query, '(?s)\]\n(.*?)(?:[.!?](?:[ \t\n\x0B\f\r]|$)|\n\n---|\n\nSORU)', 1)"


def _way(scope: str = "true") -> str:
    """The whole way from a question to its answer in SQL, letter counts being the vectors: answers (query_id, query,
    answer, source_ids, lines)."""
    words = f"list_slice(regexp_extract_all(left(content, 500), '[{R.LETTERS}]{{4,}}'), 1, 12)"
    return f"""with {CORPUS}, {questions_sql()}, chunks as (select * exclude (embedding), {_letters("content")} as v from corpus), asked as (select query_id, query, {_letters("query")} as qv0 from questions),
 known as (select q.query_id, q.query, c.content, {_CHUNK_HEADER} as h, row_number() over (partition by q.query_id order by {_cosine("c.v", "q.qv0")} desc, c.id) as r from chunks c cross join asked q where list_sum(c.v) > 0 and {_KNOWN} qualify r <= 3),
 words as (select query_id, query, r, unnest({words}) as w, generate_subscripts({words}, 1) as i from known),
 firsts as (select query_id, query, lower(w) as w, min(r * 100 + i) as place from words where not contains(lower(query), lower(w)) group by all),
 eight as (select * from firsts qualify row_number() over (partition by query_id order by place) <= 8),
 terms as (select query_id, string_agg(w, ', ' order by place) as terms from eight group by 1), heads as (select query_id, list(h order by r) as headers from known where h <> '' group by 1),
 wide as (select a.query_id, a.query, coalesce(h.headers, []) as headers, case when t.terms is null then a.query else a.query || ' (' || t.terms || ')' end as expanded from asked a left join terms t using (query_id) left join heads h using (query_id)),
 vectors as (select *, {_letters("expanded")} as qv from wide),
 near as (select q.query_id, q.query, q.headers, c.*, {_CHUNK_HEADER} as h, {_cosine("c.v", "q.qv")} as s from chunks c cross join vectors q where list_sum(c.v) > 0 and {_LIVE} and {scope} qualify row_number() over (partition by q.query_id order by s desc, c.id) <= 30),
 scored as (select *, round(s + 0.12 * (case when {_WANTS.format(q="query")} then {_NUMBER.format(c="content")} else 0.0 end) + 0.10 * {_OVERLAP.format(q="query", c="content")}
   + 0.08 * coalesce(list_max(list_transform(headers, lambda t: {_HSIM.format(h="lower(h)", t="lower(t)")})), 0.0), 6) as score from near where s >= 0),
 top as (select *, {_SHOWN} as shown, row_number() over (partition by query_id order by score desc, s desc, id) as rank from scored qualify rank <= 5),
 found as (select query_id, list(id order by rank) as source_ids,
   string_agg('[Kaynak ' || rank || ': ' || filename || case when source_page is null then '' else ' | Sayfa: ' || source_page end || case when shown is null then '' else ' | Bölüm: ' || shown end || ' | Benzerlik: %' || cast(round_even(s * 100, 0) as integer) || ']' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context,
   string_agg('  • ' || filename || case when source_page is null then '' else ' | Sayfa ' || source_page end || case when shown is null then '' else ' - ' || shown end || ' (Güven: %' || cast(round_even(least(1.0, s) * 100, 0) as integer) || ')' || chr(10), '' order by rank) as lines from top group by 1),
 answers as (select a.query_id, a.query, f.source_ids, f.lines, case when {_SENTENCE} = '' then '?' else trim({_SENTENCE} || '.', ' ') end as answer from asked a join found f using (query_id))"""


def _answers(spark, d, **scope):
    embed = embedder(letter_counts)
    chunks = settled(corpus(spark, d).withColumn("embedding", embed(F.col("content"))), "chunks")
    return retrieval.answer(chunks, questions(spark, d).select("query_id", "query"), 5, embed, first_sentence, **scope)


@query(_way() + " select query_id, query, answer, array_to_string(source_ids, ',') as source_ids, 'GLOBAL' as mode from answers")
def rag_end_to_end(spark, d):
    return _answers(spark, d).select("query_id", "query", "answer", F.array_join(F.transform("sources", lambda s: s["id"].cast("string")), ",").alias("source_ids"), "mode")


@query(_way("unit = 'en'") + " select query_id, answer, cast(len(source_ids) as integer) as n, 'SCOPED' as mode from answers")
def rag_scoped(spark, d):
    return _answers(spark, d, unit="en").select("query_id", "answer", F.size("sources").alias("n"), "mode")


@query()
def sse_frames(spark, d):
    return retrieval.frames(_answers(spark, d))


@query(_way() + " select query_id, '📚 KAYNAKLAR (' || len(source_ids) || ' chunk):' || chr(10) || lines || chr(10) || repeat('=', 70) || chr(10) || chr(10) || answer as stream from answers")
def answer_stream(spark, d):
    """Answers as plain text streams, below their sources."""
    return retrieval.banner(_answers(spark, d))
