"""Decontamination against brute force over all items and places."""

import random

from brindle.llm import decontam
from brindle.llm.queries import QUERIES
from tests.llm.data import documents, empty, save, words


def nearest(item, text):
    """Least edit distance between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def planted(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 40)))) for i in range(25)]
    rows = []
    for i, (_, text) in enumerate(items):
        w = text.split()
        for edits in range(0, int(0.2 * len(w)) + 3, 2):
            t = list(w)
            for _ in range(edits):
                at = rng.randrange(len(t))
                kind = rng.randrange(3)
                if kind == 0:
                    t[at] = rng.choice(vocabulary)
                elif kind == 1:
                    t.insert(at, rng.choice(vocabulary))
                else:
                    del t[at]
            rows.append((len(rows) + 1000, f"{words(rng, 15)} {' '.join(t).upper()}. {words(rng, 10)}", "en", "s", 1))
    docs = documents(spark, 20, clashing=True).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    bench = spark.createDataFrame([*items, (None, "an item that has no id of its own"), (900, None), (901, ""), (902, "very few words")], "item_id long, text string")
    return docs, bench


def test_recall_against_brute_force(spark, tmp_path):
    docs, bench = planted(spark)
    got = {}
    d = save(tmp_path, spark, documents=docs, benchmark=bench)
    found = decontam.find_items(docs, bench).collect()
    for r in found:
        got.setdefault((r["doc_id"], r["text"]), set()).update(x["item_id"] for x in r["leaks"])
    items = [(r["item_id"], decontam.words_of(r["text"])) for r in bench.collect() if r["item_id"] is not None and r["text"]]
    want, extra, hits = 0, 0, 0
    for r in found:
        if len(r["text"] or "") > 5000:
            continue
        text = decontam.words_of(r["text"])
        for i, w in items:
            near = nearest(w, text) <= (int(0.2 * len(w)) if len(w) >= 5 else 0)
            has = i in got[(r["doc_id"], r["text"])]
            want += near
            hits += near and has
            extra += has and not near
    assert extra == 0 and want > 80 and hits >= 0.99 * want
    rows = QUERIES["op4_benchmark_decontamination"](spark, d).collect()
    assert len(rows) == docs.count() and sum(r["contaminated"] for r in rows) == sum(bool(r["leaks"]) for r in found)
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r["leaks"] for r in found)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, bench = planted(spark)
    whole = {(r["doc_id"], r["text"]): sorted(x["item_id"] for x in r["leaks"]) for r in decontam.find_items(docs, bench).collect()}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 400)
    parts = {(r["doc_id"], r["text"]): sorted(x["item_id"] for x in r["leaks"]) for r in decontam.find_items(docs, bench).collect()}
    assert whole == parts


def test_items_without_an_id_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "here an item that has no id of its own stands"), (2, "and the other one with five words more"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "an item that has no id of its own"), (7, "something else that is not here"), (7, "the other one with five words")], "item_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontam.find_items(docs, bench).collect()}
    assert got == {1: [None], 2: [7], 3: []}
    assert [r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()] == [3]


def test_without_enough_tables_all_candidates_are_verified(spark, monkeypatch):
    docs, bench = planted(spark)
    monkeypatch.setattr(decontam, "TABLES", 1)
    items = [(r["item_id"], decontam.words_of(r["text"])) for r in bench.collect()]
    assert decontam.Items(items).choose(1.1) == (0, 1.0)
    every = {(r["doc_id"], r["text"]): {x["item_id"] for x in r["leaks"]} for r in decontam.find_items(docs, bench, recall=1.1).collect()}
    for (_, text), found in every.items():
        if len(text or "") < 5000:
            assert found == {i for i, w in items if w and nearest(w, decontam.words_of(text)) <= (int(0.2 * len(w)) if len(w) >= 5 else 0)}


def test_empty_tables(spark):
    docs, bench = planted(spark)
    assert decontam.find_items(empty(spark), bench).count() == 0
    assert decontam.decontaminate(docs, bench.where("false")).count() == docs.count()
