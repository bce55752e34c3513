"""Answers are looked for in every document, with a given vector or without."""

from brindle.plans import q_search, views


def test_answers_search_documents_without_a_given_vector(spark, small, tmp_path, monkeypatch):
    for name in ("documents", "embeddings"):
        df = spark.read.parquet(f"{small}/{name}.parquet")
        (df.where("vec_id < 20") if name == "embeddings" else df).write.parquet(f"file://{tmp_path}/{name}.parquet")
    d, seen = f"file://{tmp_path}", []
    monkeypatch.setattr(q_search, "settled", lambda df, what: seen.append(views.settled(df, what)) or seen[-1])
    q_search.QUERIES["rag_end_to_end"](spark, d).collect()
    want = {r[0] for r in views.table(spark, d, "documents").select("doc_id").collect()}
    assert {r[0] for r in seen[0].where("embedding is not null").select("id").collect()} == want and len(want) > 20


def test_answers_are_asked_every_hundredth_vector(spark, small):
    want = {r[0] for r in views.table(spark, small, "embeddings").where("vec_id % 100 = 0").select("vec_id").collect()}
    got = {r["query_id"] for r in q_search.QUERIES["rag_end_to_end"](spark, small).select("query_id").collect()}
    assert got == want and max(got) >= 100
