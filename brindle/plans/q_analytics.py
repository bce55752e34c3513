"""Queries over the store and the logs: reports, changes, limits, files, streams."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import functions as F

from ..functions import models
from ..functions.classify import is_credit_report
from ..functions.normalize import upper
from ..operators import analytics as A
from ..operators import retrieval
from ..sinks import store as S
from ..sources import files as files_
from ..sources import scans
from ..streaming import continuous, limits
from .views import CORPUS, LOGS, corpus, query_logs, table, work_path

QUERIES: dict = {}
ORACLES: dict = {}
TODAY = "2024-01-02"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("select count(text) as n_texts, cast(ceil(count(text) / 128) as bigint) as n_requests, cast(coalesce(sum(length(text)), 0) // greatest(count(text), 1) as bigint) as avg_input from documents")
def embedding_load(spark, d):
    return A.embedding_load(table(spark, d, "documents"))


@query(f"with {CORPUS} select count(id) as total_documents from corpus")
def count_chunks(spark, d):
    return A.count_chunks(corpus(spark, d))


@query(f"""with {CORPUS}, {LOGS}, a as (select count(distinct filename) as total_documents, count(id) as total_chunks, coalesce(sum(length(content)), 0)::bigint as total_chars, count(distinct case when cast(created_at as date) = date '{TODAY}' then filename end) as documents_ingested_today from corpus),
 b as (select count(id) as total_queries, cast(trunc(coalesce(avg(response_time_ms), 0)) as integer) as avg_query_response_time_ms, count(*) filter (cast(created_at as date) = date '{TODAY}') as queries_today from query_logs)
 select *, case when total_chunks > 0 then total_chars // total_chunks else 0 end as avg_chunk_size from a, b""")
def analytics_dashboard(spark, d):
    return A.dashboard(corpus(spark, d), query_logs(spark, d), TODAY)


@query(f"with {CORPUS} select filename, count(*) as n_chunks, coalesce(sum(length(content)), 0)::bigint as total_chars from corpus where deleted_at is null group by 1")
def file_summary(spark, d):
    return A.file_summary(corpus(spark, d))


@query(f"with {CORPUS} select id, filename, chunk_index, cast(length(content) as integer) as chars, left(content, 300) as head, doc_type, header, sum(length(content)) over (partition by filename order by chunk_index, id)::bigint as running_chars from corpus where deleted_at is null")
def chunk_report(spark, d):
    return A.chunk_report(corpus(spark, d))


@query(f"with {CORPUS} select coalesce(strftime(max(created_at), '%Y-%m-%dT%H:%M:%S'), 'Never') as last_ingestion from corpus")
def last_ingestion(spark, d):
    return A.last_ingestion(corpus(spark, d))


@query("select doc_id, length(text) // 4 as tokens from documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", models.token_estimate(F.col("text")).alias("tokens"))


@query(f"with {CORPUS} select id, filename, unit, collection, chunk_index, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as created_at, cast(length(content) as integer) as size_chars from corpus")
def document_list(spark, d):
    return A.document_list(corpus(spark, d)).drop("metadata")


@query(f"with {CORPUS} select id, chunk_index, content from corpus where filename = 'src1.txt'")
def get_by_filename(spark, d):
    return A.by_filename(corpus(spark, d), "src1.txt").select("id", "chunk_index", "content")


@query(f"with {CORPUS} select id, filename, content from corpus where id = 42")
def get_by_id(spark, d):
    return A.by_id(corpus(spark, d), 42).select("id", "filename", "content")


@query(f"with {CORPUS} select '2.0' as api_version, strftime(max(created_at), '%Y-%m-%dT%H:%M:%S') as last_ingestion from corpus")
def system_info(spark, d):
    return A.system_info(corpus(spark, d)).select("api_version", "last_ingestion")


@query("select source as filename, case when n % 7 = 0 then 'error' else 'success' end as status, case when n % 7 = 0 then 0 else n end as chunks_ingested, case when n % 7 = 0 then 0 else chars // 4 end as total_tokens from (select source, count(*) as n, sum(length(text))::bigint as chars from documents group by 1)")
def ingestion_summary(spark, d):
    """Each source as a file of its documents; those of a count that seven divides could not be read."""
    docs = table(spark, d, "documents").select(F.col("source").alias("filename"), "text")
    per = docs.groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    files = per.select("filename", F.repeat(F.lit("x"), F.col("chars").cast("int")).alias("text"), F.when(F.col("n") % 7 == 0, F.lit("bad")).alias("error"))
    return A.ingestion_summary(files, docs).drop("error")


_NEW = "select id, filename, unit, collection, chunk_index, content from corpus"


def _plain(df):
    return df.select("id", "filename", "unit", "collection", "chunk_index", "content")


@query(f"with {CORPUS}, new as (select id + 1000000 as id, filename, 'en' as unit, collection, chunk_index, upper(content) as content from corpus where filename in ('src1.txt', 'src2.txt') and unit = 'en')\n {_NEW} where not (filename in ('src1.txt', 'src2.txt') and unit = 'en') union all select * from new")
def reingest_upsert(spark, d):
    """Two files come again for one unit, in all its collections."""
    rows = _plain(corpus(spark, d))
    new = rows.where(F.col("filename").isin("src1.txt", "src2.txt") & (F.col("unit") == "en")).withColumns({"id": F.col("id") + 1000000, "content": upper(F.col("content"))})
    scopes = spark.createDataFrame([("src1.txt", "en", None), ("src2.txt", "en", None)], "filename string, unit string, collection string")
    return S.replaced(rows, new, scopes)


@query(f"with {CORPUS} {_NEW} where not (filename = 'src1.txt' and collection = 'c1')")
def delete_scoped(spark, d):
    return S.without(_plain(corpus(spark, d)), "src1.txt", None, " c1 ")


@query(f"with {CORPUS} {_NEW} where not (filename = 'src2.txt') union all select id + 500000, 'src2.txt', unit, 'c9', chunk_index, content from corpus where filename = 'src4.txt'")
def store_roundtrip(spark, d):
    """The store's tables: append, replace and delete, written and read."""
    rows = corpus(spark, d)
    st = S.DocumentStore(spark, work_path(spark, "store"))
    st.create_tables()
    keep = F.to_json(F.struct(F.col("id").alias("k")))
    st.append(rows.where("filename <> 'src4.txt'").withColumn("doc_metadata", keep))
    st.append(rows.where("filename = 'src4.txt'").withColumn("doc_metadata", keep))
    new = rows.where("filename = 'src4.txt'").withColumns({"filename": F.lit("src2.txt"), "collection": F.lit("c9"), "doc_metadata": F.to_json(F.struct((F.col("id") + 500000).alias("k")))})
    st.replace("src2.txt", new)
    first = st.table("chunks").agg(F.min("id")).first()[0]
    again = st.table("chunks").where(F.col("id") == first).withColumn("filename", F.lit("gone.txt"))
    st.append(again)
    st.delete_by_filename("gone.txt", unit=again.first()["unit"])
    return st.table("chunks").select(F.get_json_object("doc_metadata", "$.k").cast("long").alias("id"), "filename", "unit", "collection", "chunk_index", "content")


@query(f"with {CORPUS} select id, filename as source, 'x' || id % 7 as doc_type, case when id % 2 = 0 then 'kept' end as own from corpus")
def metadata_merge(spark, d):
    k = F.col("id")
    own = F.to_json(F.struct(F.lit("old").alias("doc_type"), F.when(k % 2 == 0, F.lit("kept")).alias("own")))
    more = F.to_json(F.struct(F.concat(F.lit("x"), (k % 7).cast("string")).alias("doc_type"), F.col("filename").alias("source")))
    got = corpus(spark, d).select("id", S.merged_metadata(own, more).alias("m"))
    return got.select("id", *[F.get_json_object("m", f"$.{c}").alias(c) for c in ("source", "doc_type", "own")])


@query("select conv_id, turn, left(text, 1000) as query_text, left(text || text, 200) as answer_preview, cast(turn * 7 as integer) as response_time_ms, 0 as chunks_retrieved, 'N/A' as top_source from conversations")
def query_log_rows(spark, d):
    c = table(spark, d, "conversations")
    answers = c.select("conv_id", "turn", F.col("text").alias("query"), F.concat("text", "text").alias("answer"), F.expr("cast(null as array<struct<filename:string>>)").alias("sources"))
    made = S.log_rows(answers, F.col("turn") * 7, F.lit("2024-01-01").cast("timestamp"), keep=("conv_id", "turn"))
    return made.drop("user_ip", "created_at")


@query(f"with {LOGS} select cast(created_at as date) as day, count(*) as n_queries, sum(response_time_ms)::bigint as total_ms from query_logs group by 1")
def stream_daily_queries(spark, d):
    """The log as a stream, summed by day. (A pattern as the path lets it be one file or a folder of files.)"""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    logs = events.select(F.col("event_id").alias("id"), F.round(F.col("value") * 10).cast("int").alias("response_time_ms"), F.col("ts").cast("timestamp").alias("created_at"))
    return continuous.run_to_table(continuous.daily_queries(logs), work_path(spark, "daily"), work_path(spark, "daily-checkpoint"), "complete")


_LIMIT = """with recursive next as (select user_id, ts, min(ts) over (partition by user_id order by ts range between interval 1 day following and unbounded following) as nxt from events),
 starts as (select user_id, min(ts) as s from events group by 1 union all select n.user_id, n.nxt from starts join next n on n.user_id = starts.user_id and n.ts = starts.s where n.nxt is not null),
 placed as (select e.*, s.s from events e asof join starts s on e.user_id = s.user_id and e.ts >= s.s),
 counted as (select event_id, user_id, row_number() over (partition by user_id, s order by ts, event_id) as hits from placed) select event_id, user_id, hits, hits <= 3 as allowed from counted"""


@query(_LIMIT)
def rate_limit_replay(spark, d):
    return limits.rate_limit_replay(table(spark, d, "events"), 3, 86_400)


@query(_LIMIT)
def rate_limit_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    return continuous.run_to_table(limits.rate_limit_stream(events, 3, 86_400), work_path(spark, "limits"), work_path(spark, "limits-checkpoint"))


@query("""with recursive upto as (select * from events where ts <= timestamp '2024-01-20'), next as (select user_id, ts, min(ts) over (partition by user_id order by ts range between interval 1 day following and unbounded following) as nxt from upto),
 starts as (select user_id, min(ts) as s from upto group by 1 union all select n.user_id, n.nxt from starts join next n on n.user_id = starts.user_id and n.ts = starts.s where n.nxt is not null),
 lasts as (select user_id, max(s) as s from starts group by 1)
 select l.user_id, case when timestamp '2024-01-20' - l.s < interval 1 day then (select count(*) from upto u where u.user_id = l.user_id and u.ts >= l.s) else 0 end as hits from lasts l""")
def rate_limit_count(spark, d):
    return limits.current_hits(table(spark, d, "events"), "2024-01-20", 86_400)


_CACHE = """with w as (select *, last_value(case when event_type = 'purchase' then {'at': ts, 'v': value} end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as put from events)
 select event_id, case when event_type <> 'purchase' and ts - put.at < interval 6 hour then put.v end as got from w"""


@query(_CACHE)
def ttl_cache_replay(spark, d):
    ops = table(spark, d, "events").withColumn("is_put", F.col("event_type") == "purchase")
    return limits.cache_replay(ops, 6 * 3600, key="user_id").select("event_id", "got")


@query(_CACHE)
def ttl_cache_stream(spark, d):
    """The same as a stream over the table's files, with state per key."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    ops = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet").withColumn("is_put", F.col("event_type") == "purchase")
    return continuous.run_to_table(limits.cache_stream(ops, 6 * 3600), work_path(spark, "cache"), work_path(spark, "cache-checkpoint"))


@query("""select conv_id, turn, case when text = '' then null else text end as answer from conversations""")
def token_stream(spark, d):
    """Texts as a model would stream them, word by word, put together again."""
    c = table(spark, d, "conversations")
    deltas = F.filter(F.split("text", "(?<= )"), lambda w: w != "")
    line = lambda w: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(w.alias("content")).alias("delta"))).alias("choices"))))
    lines = F.concat(F.transform(deltas, line), F.array(F.lit(": ping"), F.lit("data: {bad"), F.lit("data: [DONE]"), F.lit('data: {"choices":[{"delta":{"content":"late"}}]}')))
    return c.select("conv_id", "turn", F.nullif(F.array_join(models.stream_tokens(lines), ""), F.lit("")).alias("answer"))


@query(f"with {CORPUS} select id, '## Sayfa 1' || chr(10) || 'Ad: ' || filename || chr(10) || unit || ': ' || collection || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'c' as text from corpus")
def pdf_table_rows(spark, d):
    """Rows of cells, told as lines, of the tables of one page."""
    pages = F.pandas_udf(lambda a, b, c: a.combine(b, lambda x, y: (x, y)).combine(c, lambda xy, z: files_.read_pdf(b"", lambda _: [([[["Ad:", xy[0]], [xy[1], z], ["a", None, "b", " c "]]], "unread")])), "string")
    return corpus(spark, d).select("id", pages(F.col("filename"), F.col("unit"), F.col("collection")).alias("text"))


@query("select source || '.pdf' as filename, '# İstihbarat Raporu — ' || source || '.pdf' || chr(10) || chr(10) || 'Sayfa sayısı: ' || count(*) || chr(10) || coalesce(string_agg(chr(10) || chr(10) || '---' || chr(10) || '## Sayfa ' || page || chr(10) || chr(10) || '*' || lang || '*', '' order by page) filter (page % 3 <> 0), '') as markdown, count(*) as n_pages, count(*) filter (page % 3 = 0) as n_errors from (select source, lang, row_number() over (partition by source order by doc_id) as page from documents) group by source")
def scanned_pages(spark, d):
    """Page images, read by a stand-in that fails at each third page, and assembled."""
    from pyspark.sql.window import Window

    page = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    images = table(spark, d, "documents").select(F.concat("source", F.lit(".pdf")).alias("filename"), page.alias("page"), F.encode("lang", "UTF-8").alias("image"))

    def read(image: bytes, page: int) -> str:
        if page % 3 == 0:
            raise ValueError("blank")
        return f"<p>*{image.decode()}*</p>"

    return scans.assemble(scans.read_pages(images, read)).drop("errors")


@query("select doc_id, doc_id % 3 = 0 or doc_id % 4 = 0 as credit from documents")
def credit_report(spark, d):
    k = F.col("doc_id")
    name = F.when(k % 3 == 0, "2024_Istihbarat.pdf").otherwise("x.pdf")
    pages = F.array(F.lit("kapak"), F.when(k % 4 == 0, "Banka Istihbarat ve Kredi Istihbarat").otherwise("Kredi Istihbarat"))
    return table(spark, d, "documents").select("doc_id", is_credit_report(name, pages).alias("credit"))


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def sample_file(kind: str, name: str, number: int) -> bytes:
    """A small file of each known format that holds a name and a number."""
    if kind == "docx":
        return _zip({"word/document.xml": f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{name}</w:t></w:r></w:p><w:tbl><w:p><w:r><w:t>no</w:t></w:r></w:p></w:tbl><w:p><w:r><w:t>{number}</w:t></w:r></w:p></w:body></w:document>'})
    if kind == "xlsx":
        return _zip({
            "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst><si><t>{name}</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>{number}</v></c></row></sheetData></worksheet>',
        })
    if kind == "pptx":
        return _zip({"ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{name}</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:r><a:t>{number}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>'})
    if kind == "HTML":
        return f"<table><tr><td>Kalem</td><td>2023/12</td></tr><tr><td>{name}</td><td>{number}</td></tr></table>".encode()
    return f"{name} {number}".encode()


@query("""with k as (select unnest(['docx', 'xlsx', 'pptx', 'HTML', 'txt', 'csv']) as k) select n_nationkey || '.' || k as filename,
 case k when 'docx' then n_name || chr(10) || n_regionkey when 'xlsx' then n_name || ' ' || case when n_regionkey = 0 then '' else n_regionkey::varchar end || chr(10) when 'pptx' then n_name || chr(10) || n_regionkey || chr(10)
  when 'HTML' then n_name || ': 2023/12 döneminde ' || n_regionkey when 'txt' then n_name || ' ' || n_regionkey end as text, k = 'csv' as failed from nation, k""")
def read_files(spark, d):
    """A folder of small files of all formats, written by tasks and read back."""
    at = work_path(spark, "files")

    def write(parts):
        from urllib.parse import urlparse

        folder = urlparse(at).path
        os.makedirs(folder, exist_ok=True)
        for pdf in parts:
            for key, name, region in zip(pdf["n_nationkey"], pdf["n_name"], pdf["n_regionkey"]):
                for kind in ("docx", "xlsx", "pptx", "HTML", "txt", "csv"):
                    with open(f"{folder}/{key}.{kind}", "wb") as f:
                        f.write(sample_file(kind, name, region))
            yield pdf[["n_nationkey"]]

    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").mapInPandas(write, "n_nationkey int").count()
    return files_.read_files(spark, at).select("filename", "text", F.col("error").isNotNull().alias("failed"))


_FRAME = """case i when 0 then '{"answer":' || to_json(text)::varchar || '}' when 1 then '{"sources":[{"filename":"a.txt","chunk_index":0,"header":null,"similarity_score":0.5,"content_preview":"p","source_pages":null}]}' else '{"debug_info":{"retrieval_mode":"GLOBAL"}}' end"""


@query(f"select conv_id, turn, i as seq, case i when 0 then 'answer' when 1 then 'sources' else 'debug_info' end as event, 'data: ' || {_FRAME} || chr(10) || chr(10) as frame from conversations, (select unnest(range(3)) as i) where i <> 1 or turn > 0")
def sse_order(spark, d):
    """Frames of made-up answers: those without a source have no frame of sources."""
    c = table(spark, d, "conversations")
    source = F.struct(F.lit("a.txt").alias("filename"), F.lit(0).alias("chunk_index"), F.lit(None).cast("string").alias("header"), F.lit(0.5).alias("similarity"), F.lit("p").alias("preview"), F.lit(None).cast("string").alias("source_pages"))
    sources = F.when(F.col("turn") > 0, F.array(source)).otherwise(F.array().cast("array<struct<filename:string,chunk_index:int,header:string,similarity:double,preview:string,source_pages:string>>"))
    answers = c.select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("answer"), sources.alias("sources"), F.struct(F.lit("GLOBAL").alias("retrieval_mode")).alias("debug_info"))
    return retrieval.frames(answers).select("query_id.conv_id", "query_id.turn", F.when(F.col("event") == "debug_info", 2).when(F.col("event") == "sources", 1).otherwise(0).cast("long").alias("seq"), "event", "frame")
