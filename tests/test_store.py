"""The store, the engine's surface and the streams."""

import json
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.config import Settings
from brindle.engine import Engine, key_hash, request_id, user_of
from brindle.operators import search
from brindle.pipeline import ingest
from brindle.plans import registry
from brindle.plans.q_analytics import sample_file
from brindle.sinks.store import DocumentStore, merged_metadata
from brindle.sources import scans
from brindle.streaming import continuous, limits
from tests.oracle import connect, rows_of, sql_rows

ROW = "filename string, chunk_index int, content string, unit string, collection string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def held(store):
    return sorted((r["filename"], r["content"], r["unit"], r["collection"]) for r in store.table("chunks").collect())


def test_replace_and_delete(spark, tmp_path):
    st = DocumentStore(spark, f"file://{tmp_path}/a", buckets=2)
    st.create_tables()
    st.create_tables()
    assert st.append(rows(spark, ("f", 0, "1", "u/1", None), ("f", 1, "2", "v", "c"), ("g", 0, "3", None, None))) == 3
    assert sorted(r["id"] for r in st.table("chunks").collect()) == [1, 2, 3]
    assert st.replace("f", rows(spark, ("f", 0, "new", "u/1", None)), unit="u/1") == 1
    assert held(st) == sorted([("f", "new", "u/1", None), ("f", "2", "v", "c"), ("g", "3", None, None)], key=lambda r: (r[0], r[1]))
    assert st.delete_by_filename("f") == 2 and st.delete_by_filename("f") == 0
    assert held(st) == [("g", "3", None, None)]
    assert st.replace_all(rows(spark, ("g", 0, "4", None, None), ("h", 0, "5", None, None))) == 1
    assert held(st) == [("g", "4", None, None), ("h", "5", None, None)]
    first = st.table("chunks").where("filename = 'h'").first()
    assert first["file_size"] == 1 and first["content_hash"] and st.delete(first["id"]) and not st.delete(first["id"])
    assert "PartitionFilters: [isnotnull(unit" in st.chunks(unit="v")._jdf.queryExecution().toString()
    assert not os.listdir(f"{tmp_path}/a/_staging") or all(x.startswith(".") for x in os.listdir(f"{tmp_path}/a/_staging"))


def test_metadata_of_the_right_wins(spark):
    df = spark.createDataFrame([('{"a":"1","b":"x"}', '{"b":"2","c":[1]}'), (None, '{"c":"3"}'), ('{"a":"1"}', "bad")], "l string, r string")
    got = [json.loads(r[0]) for r in df.select(merged_metadata(F.col("l"), F.col("r"))).collect()]
    assert got == [{"a": "1", "b": "2", "c": "[1]"}, {"c": "3"}, {"a": "1"}]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    body = "# Limit Risk\n" + "Firma A satırı 100 ve limit risk toplam\n" * 20
    (folder / "teklif_a.txt").write_text(body, encoding="utf-8")
    (folder / "sozluk.txt").write_text("# Terim\n" + "Limit açıklama: bir müşteriye verilen en yüksek tutar anlamına gelir.\n" * 3, encoding="utf-8")
    (folder / "bad.csv").write_bytes(b"x")
    (folder / "b.docx").write_bytes(sample_file("docx", "N" * 80, 3))
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}", Settings(embedding_dim=32, chunk_size=1000))
    return e, folder


def test_ingest_and_ask(spark, engine):
    e, folder = engine
    for _ in range(2):  # the second time replaces the first
        told = {r["filename"]: (r["status"], r["chunks_ingested"]) for r in e.ingest(f"file://{folder}", unit="krd").collect()}
    assert told["bad.csv"] == ("error", 0) and told["teklif_a.txt"] == ("success", 2) and told["b.docx"][0] == "success"
    assert e.count().first()[0] == sum(n for _, n in told.values())
    got = e.query_one("limit risk ne kadar", 3, unit="krd").first()
    assert "Limit Risk" in got["answer"] and got["sources"][0]["filename"] == "teklif_a.txt" and got["debug_info"]["retrieval_mode"] == "SCOPED"
    nothing = e.query_one("limit risk", 3, unit="other").first()
    assert nothing["sources"] is None and "kaynak" in nothing["answer"]
    with pytest.raises(ValueError):
        e.query_one("limit risk", 3)
    log = e.store.table("query_logs").orderBy("id").collect()
    assert [r["id"] for r in log] == [1, 2] and log[0]["top_source"] == "teklif_a.txt" and log[1]["top_source"] == "N/A"
    frames = e.query_stream(spark.createDataFrame([(1, "limit risk")], "query_id long, query string"), 2).orderBy("seq").collect()
    assert [f["event"] for f in frames] == ["answer", "sources", "debug_info"] and json.loads(frames[0]["frame"][6:])["answer"]
    assert e.analytics("1999-01-01").first()["total_queries"] == 3 and e.health() == "healthy"
    assert {r["filename"] for r in e.documents().collect()} == {"teklif_a.txt", "sozluk.txt", "b.docx"}
    assert e.system_info().first()["embedding_dim"] == 32
    assert e.delete_by_filename("b.docx") == 1
    with pytest.raises(KeyError):
        e.delete_by_filename("b.docx")


def test_uploads_stay_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<p>x</p><p>y</p>", encoding="utf-8")
    e = Engine(spark, f"file://{tmp_path}/st", Settings(embedding_dim=8))
    assert e.ingest_with_metadata(f"file://{tmp_path}/in", "2024-01-01", '{"chunk_0": [1, 2]}') == 1
    row = e.store.table("chunks").first()
    meta = json.loads(row["doc_metadata"])
    assert row["content"] == "x\ny" and row["embedding"] is None and meta["file_type"] == ".html" and meta["pages"] == {"chunk_0": [1, 2]}


def test_folders_are_ingested_as_they_grow(spark, tmp_path):
    (tmp_path / "in").mkdir()
    st = DocumentStore(spark, f"file://{tmp_path}/st")
    st.create_tables()
    text = "# A\n" + "some words of a line\n" * 5
    for name in ("a.txt", "b.txt"):
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
        continuous.ingest_folder(spark, f"file://{tmp_path}/in", st, ingest, f"file://{tmp_path}/cp", unit="u").awaitTermination()
    assert sorted(r["filename"] for r in st.table("chunks").collect()) == ["a.txt", "b.txt"]


def test_a_file_that_comes_empty_or_broken(spark, tmp_path):
    """A file that comes again without text loses its chunks; one that cannot be read keeps them and is noted."""
    st = DocumentStore(spark, f"file://{tmp_path}/store")
    st.create_tables()
    ingest = lambda done: done.where("trim(text) <> ''").select("filename", F.col("text").alias("content"))
    run = lambda: continuous.ingest_folder(spark, f"file://{tmp_path}/in", st, ingest, f"file://{tmp_path}/cp", unit="u").awaitTermination()
    (tmp_path / "in").mkdir()
    for name in ("a", "b", "c"):
        (tmp_path / "in" / f"{name}.txt").write_text("some text", encoding="utf-8")
    run()
    for sub, name, data in (("x", "a.txt", b"  "), ("x", "b.txt", b"\xff\xfe\xfa")):
        (tmp_path / "in" / sub).mkdir(exist_ok=True)
        (tmp_path / "in" / sub / name).write_bytes(data)
    run()
    assert sorted(r["filename"] for r in st.table("chunks").collect()) == ["b.txt", "c.txt"]
    noted = spark.read.parquet(st.path("ingest_errors")).collect()
    assert [r["filename"] for r in noted] == ["b.txt"] and "UnicodeDecodeError" in noted[0]["error"]


def test_state_of_rate_limits_expires(spark, tmp_path):
    """With a bound on lateness the stream decides as the replay does, while keys that are done with are forgotten."""
    rows = [(i, i % 3, f"2024-01-{1 + i // 20:02d} 00:{i % 20:02d}:00") for i in range(200)]
    for n in range(0, 200, 50):
        spark.createDataFrame(rows[n : n + 50], "event_id long, user_id long, ts string").selectExpr("event_id", "user_id", "cast(ts as timestamp) as ts").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/ev")
    schema = "event_id long, user_id long, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/ev")
    got = continuous.run_to_table(limits.rate_limit_stream(stream, 3, 3600, late="30 days"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    want = limits.rate_limit_replay(spark.read.schema(schema).parquet(f"file://{tmp_path}/ev"), 3, 3600)
    assert sorted(map(tuple, got.select("event_id", "hits").collect())) == sorted(map(tuple, want.select("event_id", "hits").collect()))


def test_page_images(spark, tmp_path):
    for n in (10, 2):
        (tmp_path / f"Page{n}.png").write_bytes(b"i%d" % n)
    got = scans.image_folder(spark, f"file://{tmp_path}").orderBy("page").collect()
    assert [(r["page"], bytes(r["image"])) for r in got] == [(2, b"i2"), (10, b"i10")]
    files = spark.createDataFrame([("a.pdf", bytearray(b"xy"))], "filename string, content binary")
    pages = scans.render_pages(files, lambda data, dpi: [data[i : i + 1] for i in range(len(data))])
    assert [(r["page"], bytes(r["image"])) for r in pages.orderBy("page").collect()] == [(1, b"x"), (2, b"y")]


def test_replay_equals_a_loop(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    state, want = defaultdict(lambda: (None, 0)), {}
    for r in events.orderBy("ts", "event_id").collect():
        start, n = state[r["user_id"]]
        if start is None or (r["ts"] - start).total_seconds() >= 7200:
            start, n = r["ts"], 0
        state[r["user_id"]] = (start, n + 1)
        want[r["event_id"]] = (n + 1, n + 1 <= 2)
    got = {r["event_id"]: (r["hits"], r["allowed"]) for r in limits.rate_limit_replay(events, 2, 7200).collect()}
    assert got == want


def test_identity_helpers():
    assert key_hash("k") == "8254c329a92850f6d539dd376f4816ee2764517da5e0235514af433164480d7a" and key_hash(None) is None
    assert user_of(None, None) == "anonymous" and user_of("h", "p") == "h" and len(request_id()) == 36 and request_id("r") == "r"


def test_capitals_of_a_reingest_are_those_of_its_sql(spark, small, tmp_path):
    """One character stays one character: no capital ``SS`` of ``ß``, no two letters of ``ﬁ`` or ``ŉ``."""
    for name in ("documents", "embeddings"):
        df = spark.read.parquet(f"{small}/{name}.parquet")
        if name == "documents":
            df = df.where("doc_id < 20").withColumns({"text": F.concat("text", F.lit("ß ﬁ ŉ ᾳ ǆ ı i ς straße 𐐨")), "source": F.lit("src1"), "lang": F.lit("en")})
        df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    got = rows_of(registry.QUERIES["reingest_upsert"](spark, f"file://{tmp_path}"))
    assert got == sql_rows(connect(str(tmp_path)), registry.ORACLES["reingest_upsert"])
    assert len(got[1]) == 20 and all("STRAẞE" in r[2] for r in got[1])


def test_nearest_rows_are_found_in_small_parts(spark, monkeypatch):
    """Similarities are held a few at a time, and a task hands on k rows a question; ties go to the lower key."""
    monkeypatch.setattr(search, "CELLS", 64)
    r = random.Random(3)
    vectors = [(i, [float(r.randint(-2, 2)) for _ in range(3)]) for i in range(500)]
    asked = [(q, [float(r.randint(-2, 2)) for _ in range(3)]) for q in range(9)]
    chunks = spark.createDataFrame(r.sample(vectors, 500), "id long, embedding array<float>").repartition(2)
    sim = lambda a, b: round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9)
    want = {(q, i) for q, v in asked if any(v) for _, i in sorted((-sim(x, v), i) for i, x in vectors if any(x))[:7]}
    found = search.top_k(chunks, spark.createDataFrame(asked, "query_id long, qv array<float>"), 7)
    assert {(x["query_id"], x["id"]) for x in found.collect()} == want


def test_pages_of_odd_lines_are_those_of_its_sql(spark, tmp_path):
    """Lines of wide spaces alone are none, tabs are one, and a line that reads like a page mark is text."""
    texts = ["a\n\u00a0\nb\n\u3000 \n\t\nc\nd\ne\nf\ng", "\n".join(["Sayfa 9", "## Sayfa 4", "x", "Sayfa 7"] * 6), "", "one"]
    rows = [(i, t, "src1", "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = rows_of(registry.QUERIES["page_asof"](spark, f"file://{tmp_path}"))
    assert got == sql_rows(connect(str(tmp_path)), registry.ORACLES["page_asof"]) and len(got[1]) > 30
