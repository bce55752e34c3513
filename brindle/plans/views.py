"""The engine's tables as derived from the test tables, in Spark and as SQL with the same rows."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.layout import spread

QUESTIONS = ("Toplam limit risk ne kadar", "that edre thlyst in thonre", "kaç tutar oran the rest", "hand was of the aneth", "Limit Risk detail of note")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, source, for work on texts row by row."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def work_path(spark, what: str) -> str:
    """A new path in the folder that all executors share (a temporary one where the session runs in one process)."""
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="brindle-")
    if "://" not in at and not at.startswith("file:"):
        at = "file://" + os.path.abspath(at)
    return f"{at.rstrip('/')}/brindle/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, whoever asks how often."""
    at = work_path(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Documents whose chunks are numbered in one group.
STRETCH = 10_000


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks: all documents, with the vector of the same number where there is one.

    A chunk's index counts the file's chunks before it. Files are few and grow, so chunks are numbered in stretches of
    ids, and small counts per file and stretch say how many chunks lie before a stretch.
    """
    k = F.col("id")
    name = F.when(F.col("source") == "src3", "src3_sozluk.txt").when(F.col("source") == "src7", "dictionary_src7.pdf").otherwise(F.concat("source", F.lit(".txt")))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("lang").alias("unit"), name.alias("filename")).withColumn("stretch", F.floor(k / STRETCH))
    before = F.sum("n").over(Window.partitionBy("filename").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = d.groupBy("filename", "stretch").agg(F.count(F.lit(1)).alias("n")).select("filename", "stretch", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("filename", "stretch").orderBy("id")) - 1
    b = d.join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), "id", "left").join(starts, ["filename", "stretch"], "left")
    header = F.when(k % 4 == 0, F.concat(F.lit("Limit Risk > Detail "), (k % 7).cast("string"))).when(k % 4 == 1, F.concat(F.lit("Sayfa "), (k % 9).cast("string"))).when(k % 4 == 2, F.lit("")).otherwise(F.lit("Note ends here."))
    meta = F.to_json(F.struct(F.when(k % 5 != 0, F.col("label") == 0).alias("is_dictionary"), F.concat(F.lit("t"), (F.col("label") % 4).cast("string")).alias("doc_type"), header.alias("header"), F.when(k % 3 == 0, (k % 50).cast("string")).alias("source_page")))
    return b.select(
        "id", "content", "unit", F.concat(F.lit("c"), (k % 3).cast("string")).alias("collection"), "filename",
        "embedding", meta.alias("doc_metadata"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=k.cast("int"))).alias("created_at"),
        F.when(k % 17 == 0, F.lit("2024-06-01").cast("timestamp")).alias("deleted_at"), (F.col("before") + within).cast("int").alias("chunk_index"),
    )


CORPUS = """corpus as (select d.doc_id as id, d.text as content, d.lang as unit, 'c' || (d.doc_id % 3) as collection,
  case d.source when 'src3' then 'src3_sozluk.txt' when 'src7' then 'dictionary_src7.pdf' else d.source || '.txt' end as filename,
  cast(e.embedding as double[]) as embedding, e.label, case when d.doc_id % 5 <> 0 and e.label = 0 then true else false end as is_dictionary, 't' || (e.label % 4) as doc_type,
  case d.doc_id % 4 when 0 then 'Limit Risk > Detail ' || (d.doc_id % 7) when 1 then 'Sayfa ' || (d.doc_id % 9) when 2 then '' else 'Note ends here.' end as header,
  case when d.doc_id % 3 = 0 then cast(d.doc_id % 50 as varchar) end as source_page,
  timestamp '2024-01-01' + to_minutes(d.doc_id) as created_at, case when d.doc_id % 17 = 0 then timestamp '2024-06-01' end as deleted_at,
  cast(row_number() over (partition by case d.source when 'src3' then 'src3_sozluk.txt' when 'src7' then 'dictionary_src7.pdf' else d.source || '.txt' end order by d.doc_id) - 1 as integer) as chunk_index
 from documents d left join embeddings e on d.doc_id = e.vec_id)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, qv: every hundredth vector of all, each with a question."""
    q = F.element_at(F.array(*[F.lit(x) for x in QUESTIONS]), (F.floor(F.col("vec_id") / 100) % len(QUESTIONS) + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), q.alias("query"), F.col("embedding").alias("qv"))


def questions_sql() -> str:
    names = ", ".join(f"'{x}'" for x in QUESTIONS)
    return f"questions as (select vec_id as query_id, ([{names}])[(vec_id // 100) % {len(QUESTIONS)} + 1] as query, cast(embedding as double[]) as qv from embeddings where vec_id % 100 = 0)"


def query_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("query_text"), F.lit(None).cast("string").alias("answer_preview"), F.round(F.col("value") * 10).cast("int").alias("response_time_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("chunks_retrieved"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("top_source"),
        F.lit(None).cast("string").alias("user_ip"), F.col("ts").alias("created_at"),
    )


LOGS = """query_logs as (select event_id as id, event_type as query_text, cast(null as varchar) as answer_preview, cast(round(value * 10) as integer) as response_time_ms,
  cast(props::json ->> '$.k' as integer) as chunks_retrieved, 'src' || (user_id % 20) as top_source, cast(null as varchar) as user_ip, ts as created_at from events)"""


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a preamble, then the lines of a document, some of them headings or below page marks."""

    def mark(x, i):
        page = F.when(i % 6 == 5, F.concat(F.lit("## Sayfa "), (F.floor(i / 6) + 1).cast("string"), F.lit("\n"))).otherwise(F.lit(""))
        return F.concat(page, F.when(i % 4 == 3, F.lit("# ")).when(i % 5 == 4, F.lit("### ")).otherwise(F.lit("")), x)

    # the SQL's trim takes all of Unicode's spaces, the built-in one the blank alone
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(r"^\p{Zs}*\z")), mark)
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.concat(F.array(F.lit("preamble")), F.coalesce(lines, F.expr("cast(array() as array<string>)"))), "\n").alias("text"))


MARKDOWN_LINES = """raw_lines as (select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as x, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1 as i from documents),
 md_lines as (select doc_id, 0 as i, 0 as j, 'preamble' as x from documents
  union all select doc_id, i + 1, 0, '## Sayfa ' || (i // 6 + 1) from raw_lines where i % 6 = 5
  union all select doc_id, i + 1, 1, case when i % 4 = 3 then '# ' when i % 5 = 4 then '### ' else '' end || x from raw_lines)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows: row_id, headers, values."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"))
    k, price = F.col("o_orderkey"), F.format_number(F.col("o_totalprice"), 0)
    heads = F.when(k % 2 == 0, F.array(*map(F.lit, ("Tür", "Risk", "PCN", "Limit", "Cur.")))).otherwise(F.array(*map(F.lit, ("Tür", "2023/12", "2024/6", "Not", "Döviz"))))
    return o.select(k.alias("row_id"), heads.alias("headers"), F.array("o_orderpriority", price, F.lit("TRY"), F.when(k % 3 == 0, F.lit("")).otherwise(price), F.lit("USD")).alias("values"))


CELLS = """cells as (select o_orderkey as row_id, case when o_orderkey % 2 = 0 then ['Tür', 'Risk', 'PCN', 'Limit', 'Cur.'] else ['Tür', '2023/12', '2024/6', 'Not', 'Döviz'] end as headers,
  [o_orderpriority, format('{:,}', cast(round_even(o_totalprice, 0) as bigint)), 'TRY', case when o_orderkey % 3 = 0 then '' else format('{:,}', cast(round_even(o_totalprice, 0) as bigint)) end, 'USD'] as vals from orders)"""
