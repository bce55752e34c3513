"""The near-dedup stage against brute force over five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from brindle.llm import shingles
from tests.llm.data import DOC

STAGE = dict(corpus_pipeline.STAGES)["simhash near-dedup"]


def plain_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similarity(a, b):
    return len(a & b) / len(a | b)


def plain_firsts(rows):
    """The least id of each component of links of 0.8 or more."""
    sets, left, firsts = {i: plain_set(t) for i, t in rows}, sorted(i for i, _ in rows), set()
    while left:
        front = [left.pop(0)]
        firsts.add(front[0])
        while front:
            x = front.pop()
            near = [y for y in left if similarity(sets[x], sets[y]) >= 0.8]
            left = [y for y in left if y not in near]
            front += near
    return firsts


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [256, 4])
def test_near_copies_go_and_no_others(spark, monkeypatch, block):
    """Copies with 1 to 8 of 200 words changed lie on both sides of 0.8; one group spans many blocks."""
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = random.Random(5)
    texts = []
    for g in range(20):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(200))
        texts += [base, *(edited(rng, base, rng.randint(1, 8)) for _ in range(30 if g == 0 else 3))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = plain_firsts(rows)
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], DOC).repartition(4)
    got = [r["doc_id"] for r in STAGE(spark, docs, "").collect()]
    assert sorted(got) == sorted(want) and 20 < len(want) < len(rows)


def test_just_below_and_at_the_bound(spark):
    """Of 40 shingles: 4 shared fewer makes 36 of 44 (0.818), 5 makes 35 of 45 (0.778)."""
    base = [f"a{i}" for i in range(44)]
    near, far = base[:-4] + ["x1", "x2", "x3", "x4"], base[:-5] + ["y1", "y2", "y3", "y4", "y5"]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate((base, near, far))], DOC)
    assert sorted(r["doc_id"] for r in STAGE(spark, docs, "").collect()) == [0, 2]


def test_the_stage_finds_near_copies_by_fingerprints(spark, monkeypatch):
    """Without the search over SimHash trees only texts of equal shingle sets go."""
    base = [f"a{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:-1] + ["x"]), " ".join(base)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOC)
    assert [r["doc_id"] for r in STAGE(spark, docs, "").collect()] == [0]
    monkeypatch.setattr(shingles, "search", lambda points: spark.createDataFrame([], "u long, v long"))
    assert sorted(r["doc_id"] for r in STAGE(spark, docs, "").collect()) == [0, 1]


@pytest.mark.parametrize("n", [1, 2, 9, 300])
def test_fingerprints_are_signs_of_weighted_sums(n):
    s = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, np.uint64))
    total, first = [0] * (shingles._LONGS * 64), None
    for h in s.tolist():
        planes = []
        for odd in shingles._ODD.tolist():
            x = h * odd % 2**64
            x ^= x >> 32
            x = x * int(shingles._MIX) % 2**64
            planes.append(x ^ x >> 32)
        bits = [[x >> b & 1 for x in planes[p * shingles._LONGS :][: shingles._LONGS] for b in range(64)] for p in range(shingles._PLANES)]
        first = first or bits[-1]
        total = [t + sum(b << p for p, b in enumerate(w)) - 3.5 for t, w in zip(total, zip(*bits))]
    assert shingles.fingerprint(s).tolist() == [f if t == 0 else int(t > 0) for t, f in zip(total, first)]


@pytest.mark.parametrize("both,one,other", [(4, 0, 1), (8, 1, 1), (40, 5, 5)])
def test_sets_of_similarity_at_the_bound_are_candidates(both, one, other):
    rng, missed, differ = np.random.default_rng(both), 0, 0
    for _ in range(500):
        s = rng.integers(0, 1 << 63, both + one + other, np.uint64)
        far = shingles.fingerprint(np.unique(s[: both + one])) != shingles.fingerprint(np.unique(np.r_[s[:both], s[both + one :]]))
        codes = far[shingles.CHECK :].reshape(shingles.TREES, shingles.CODE).sum(1)
        missed += codes.min() > shingles.RADIUS or far[: shingles.CHECK].sum() > shingles.FAR
        differ += far.mean()
    assert missed <= 2 and 0.14 < differ / 500 < 0.17


@pytest.mark.parametrize("shard", [1 << 18, 100])
def test_search_over_dealt_trees_equals_brute_force(spark, monkeypatch, shard):
    """Groups of near copies, single texts, and a cloud that no vantage divides, in whole trees and in dealt ones."""
    monkeypatch.setattr(shingles, "SHARD", shard)
    monkeypatch.setattr(shingles, "CELL", 40)
    rng, sets = np.random.default_rng(8), []
    for size in [300, *[1] * 400, *[5] * 80]:
        base = rng.integers(0, 1 << 63, 60, np.uint64)
        for _ in range(size):
            new = rng.integers(0, 2 if size == 300 else 12)
            sets.append(np.unique(np.r_[base[new:], rng.integers(0, 1 << 63, new, np.uint64)]))
    prints = {shingles.set_key(s): shingles.packed(shingles.fingerprint(s)) for s in sets}
    rows = [(k, int.from_bytes(p[:8], "little", signed=True), p) for k, p in prints.items()]
    check, codes = shingles.opened(shingles.pa.array([r[2] for r in rows], shingles.pa.binary()))
    close = (np.bitwise_count(codes[:, None] ^ codes[None]) <= shingles.RADIUS).any(2)
    close &= np.bitwise_count(check[:, None] ^ check[None]).sum(2, dtype=int) <= shingles.FAR

    def components(pairs):
        up = {r[1]: r[1] for r in rows}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = sorted((top(a), top(b)))
            up[b] = a
        return {x: top(x) for x in up}

    got = shingles.search(spark.createDataFrame(rows, "key long, fp long, print binary")).collect()
    want = components((rows[i][1], rows[j][1]) for i, j in zip(*np.nonzero(close)))
    assert components((r["u"], r["v"]) for r in got) == want and 400 < len(set(want.values())) < len(rows) - 300
