"""Near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from brindle.llm import simhash
from brindle.llm.queries import QUERIES
from tests.llm.data import documents, empty, save


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=2):
    up = list(range(len(fps)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def check(rows, texts):
    fp = {}
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0), plain_fingerprint(r["text"])) for r in texts)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), int(r["fingerprint"], 16)) for r in rows)
    assert got == want
    keyed = [(r["doc_id"], plain_fingerprint(r["text"])) for r in texts]
    comp = plain_components([f for _, f in keyed])
    least = {}
    for (d, f), c in zip(keyed, comp):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    for (d, f), c in zip(keyed, comp):
        fp[(d, f)] = least.get(c)
    for r in rows:
        assert r["component_id"] == fp[(r["doc_id"], int(r["fingerprint"], 16))]


def test_query_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(QUERIES["op3_simhash_vantage_trees"](spark, small).collect(), docs.collect())


def test_defined_cases(spark, tmp_path):
    docs = documents(spark, clashing=True)
    check(QUERIES["op3_simhash_vantage_trees"](spark, save(tmp_path, spark, documents=docs)).collect(), docs.collect())


def test_empty_table(spark, tmp_path):
    assert QUERIES["op3_simhash_vantage_trees"](spark, save(tmp_path, spark, documents=empty(spark))).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_links_among_many_near_points(spark, seed, monkeypatch):
    """Chains and clouds of near fingerprints, over many small shards and blocks."""
    monkeypatch.setattr(simhash, "SHARD", 20)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(seed)
    points = {rng.getrandbits(64) for _ in range(150)}
    for p in list(points)[:40]:
        for _ in range(8):
            for _ in range(rng.randint(1, 2)):
                p ^= 1 << rng.randrange(64)
            points.add(p)
    points = sorted(points)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    got = simhash.components(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long"))
    comp = plain_components(points)
    least = {}
    for i, c in enumerate(comp):
        least.setdefault(c, i)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: least[c] for i, c in enumerate(comp)}


def test_a_dense_cloud_is_dealt_in_cells(spark, monkeypatch):
    """All 512 ways to turn nine bits: no vantage divides them, and two such clouds do not link."""
    monkeypatch.setattr(simhash, "SHARD", 64)
    monkeypatch.setattr(simhash, "CELL", 50)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(3)
    points = {c ^ sum(1 << 7 * j for j in range(9) if i >> j & 1) for c in (rng.getrandbits(64), rng.getrandbits(64)) for i in range(512) if i % 5}
    points = np.array(sorted(points), np.uint64)
    _, dense = simhash.build_tree(points, len(points) / 64, 2)
    assert max(dense) > 2
    got = simhash.components(spark.createDataFrame(list(enumerate(points.view(np.int64).tolist())), "doc_id long, fp long"))
    comp = plain_components(points.tolist())
    least = {}
    for i, c in enumerate(comp):
        least.setdefault(c, i)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: least[c] for i, c in enumerate(comp)}
