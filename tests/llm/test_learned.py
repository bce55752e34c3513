"""Quality ranking, quality rules and the base statistics."""

import re

import numpy as np
import pytest

from brindle.llm import ranking, rules, textstats
from brindle.llm.queries import QUERIES
from tests.llm.data import documents, empty, labels, save


def joined(spark, small, name):
    y = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    return [(r, y[r["doc_id"]]) for r in QUERIES[name](spark, small).collect() if r["doc_id"] in y]


def test_held_out_rows_are_ranked_well(spark):
    rows = joined(spark, "/root/testdata/sf0.01", "op2_bradley_terry_quality")
    held = [(r["score"], y) for r, y in rows if r["held_out"]]
    good, poor = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in poor]) > 0.97
    assert np.mean([r["predicted"] == y for r, y in rows if r["held_out"]]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r, _ in rows)


def test_labels_held_out_are_never_read(spark, small, tmp_path):
    import zlib

    docs, y = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet").collect()
    turned = [(r["doc_id"], 1 - r["quality"] if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 else r["quality"], r["toxic"]) for r in y]
    d = save(tmp_path, spark, documents=docs, labels=spark.createDataFrame(turned, "doc_id long, quality int, toxic int"))
    scores = lambda d: {r["doc_id"]: r["score"] for r in QUERIES["op2_bradley_terry_quality"](spark, d).collect()}
    a, b = scores(small), scores(d)
    assert a == pytest.approx(b) and all((r["held_out"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in QUERIES["op2_bradley_terry_quality"](spark, small).collect())


@pytest.mark.parametrize("name, n", [("op2_bradley_terry_quality", 69), ("op6_rules_isolation_forest", 69)])
def test_defined_cases(spark, tmp_path, name, n):
    d = save(tmp_path, spark, documents=documents(spark, clashing=True), labels=labels(spark))
    assert QUERIES[name](spark, d).count() == n
    none = save(tmp_path, spark, labels=labels(spark).where("false"))
    got = QUERIES[name](spark, none).collect()
    assert len(got) == n and all(r["score"] == 0.5 and r["predicted"] == 1 for r in got) if "op2" in name else all(r["kept"] == (not r["base_failed"]) for r in got)
    assert QUERIES[name](spark, save(tmp_path, spark, documents=empty(spark), labels=labels(spark))).count() == 0


def test_many_rows_of_one_labelled_document_count_once(spark):
    """The driver gathers documents, not rows; and the threshold lies where the share of poor documents ends."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    rows = [(i, " ".join(word() if i % 3 else "%%%" for _ in range(int(rng.integers(20, 60))))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    y = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    many = docs.unionByName(docs.where("doc_id = 5").crossJoin(spark.range(5000)).select("doc_id", "text"))
    known = ranking.featured(many.select(F.col("doc_id").alias("_id"), "text"), ["_id"], "_x")
    x, good = ranking.gathered(ranking.labelled(known, ranking.one_label(y, None)), 10**6)
    assert len(x) == len(good) == 300
    got = ranking.rank_quality(many, y).select("doc_id", "predicted").distinct().collect()
    assert len(got) == 300 and sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in got) >= 298


def plain_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


TEXTS = ["", None, "a b", "é ü x y #<>", ("one two three four five six seven eight nine " * 4).strip(), "a\na\n\n \nb\r\na\r", "x " * 40, "1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8 9"]


@pytest.mark.parametrize("text", TEXTS)
def test_base_rules(text):
    assert textstats.base_rules(text) == plain_base(text)


def test_base_rules_of_tables(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op6_rules_isolation_forest"](spark, small).collect():
        if len(texts[r["doc_id"]]) > 4000:
            continue
        n, chars, symbols, lines, repeats = want = plain_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n) and not (r["base_failed"] and r["kept"])


def test_forest_keeps_the_good_and_rejects_most_of_the_rest(spark):
    rows = joined(spark, "/root/testdata/sf0.01", "op6_rules_isolation_forest")
    assert np.mean([r["kept"] for r, y in rows if y and not r["base_failed"]]) > 0.97
    assert np.mean([r["kept"] for r, y in rows if not y]) < 0.15


def test_isolated_points_have_short_paths():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(400, len(textstats.FEATURES)))) + 1
    x[:20] *= 30
    f = rules.Forest(x, np.arange(400) >= 20)
    s = f.score(x)
    assert s[:20].min() > np.quantile(s[20:], 0.95)
    assert rules.Forest(x, np.ones(400, bool)).score(x).max() == 0


def test_pairs_order_documents():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) + 3
    good = x[:, 0] - x[:, 1] > 0
    r = ranking.Ranker(x, good)
    s = r.score(x)
    assert np.mean((s >= 0.5) == good) > 0.95
