"""The corpus pipeline: each stage alone, the whole against a plain version, and its guard."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import decontam
from tests.llm.data import documents, empty, labels, save
from tests.llm.test_decontam import planted
from tests.llm.test_native import secret_documents
from tests.llm.test_simhash import plain_components, plain_fingerprint

STAGES = dict(corpus_pipeline.STAGES)


def bench(spark):
    return planted(spark)[1]


def test_stages_keep_columns(spark, tmp_path):
    d = save(tmp_path, spark, labels=labels(spark), benchmark=bench(spark))
    for docs in (documents(spark, clashing=True), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema], name
            before, after = {tuple(r) for r in docs.drop("text", "n_chars").collect()}, {tuple(r) for r in out.drop("text", "n_chars").collect()}
            assert after <= before
        assert STAGES["best-fit packing"](spark, docs, d).count() >= docs.count()


def test_one_of_each_group_stays(spark, tmp_path):
    docs = documents(spark, clashing=True)
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    comp = plain_components([plain_fingerprint(r["text"]) for r in rows])
    least = {}
    for r, c in zip(rows, comp):
        least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
    got = [r["doc_id"] for r in STAGES["simhash near-dedup"](spark, docs, "").collect() if r["doc_id"] is not None]
    assert set(got) == set(least.values())


def test_rows_of_one_id_with_several_texts(spark):
    a, b = "one text of nine words that stands here alone", "another text of as many words but not the same"
    docs = spark.createDataFrame([(0, b, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, a, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["text"]) for r in STAGES["simhash near-dedup"](spark, docs, "").collect()) == [(0, b), (1, a)]


def test_run_over_odd_and_empty_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns go through all stages; so does an empty table."""
    d = save(tmp_path, spark, documents=documents(spark, clashing=True), labels=labels(spark), benchmark=bench(spark))
    assert corpus_pipeline.run(spark, d).count() > 0
    d = save(tmp_path, spark, documents=empty(spark), labels=labels(spark), benchmark=bench(spark))
    assert corpus_pipeline.run(spark, d).count() == 0


def test_secrets_are_masked(spark):
    docs = secret_documents(spark)
    out = {(r["doc_id"], r["source"]): r for r in STAGES["secret scans"](spark, docs, "").collect()}
    assert out[(210, "own1")]["text"] == "my password: [secret]\nagain Secret=[secret]" and out[(210, "own1")]["n_chars"] == 43
    assert out[(202, "own2")]["text"].startswith("API_KEY = 'EXAMPLE")
    assert len(STAGES["secret scans"](spark, docs, "").collect()) == docs.count()


def test_leaks_go(spark, tmp_path):
    docs, items = planted(spark)
    out = STAGES["benchmark decontamination"](spark, docs, save(tmp_path, spark, benchmark=items))
    want = decontam.find_items(docs, items).where(F.size("leaks") == 0).count()
    assert out.count() == want < docs.count()


def test_whole_run_equals_its_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, left, small).collect()
        left = spark.createDataFrame(rows, docs.schema)
    ids = {r["doc_id"] for r in left.collect()}
    got = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in got} == ids and 0 < len(ids) < docs.count()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace as N

    from brindle.llm.common import shared_dir

    fake = N(conf=N(get=lambda k, d="": ""), sparkContext=N(getConf=lambda: N(get=lambda k, d="": ""), master="spark://h:7077"))
    with pytest.raises(ValueError):
        shared_dir(fake)
