"""Packing and token files: exact round trips, and the library's own ids."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brindle.llm import packing, tokenfile
from brindle.llm.common import new_path
from brindle.llm.queries import QUERIES, vocabulary
from brindle.llm.tokens import read_spec, tokenizer
from tests.llm.data import documents, empty, save

ODD = ["", " ", "  a", "a  b \n c", "don't I'LL", "Æther ﬁ İstanbul ǅ", "<|endoftext|> x", "a b c", "😀 café é", "1234 5,6", "\n\n\n", "x" * 500, "\0a\0 b", "don't’s", "tab\tend ", " lead", "ΑΣ ΣΑΣ", "日本語 テキスト"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(spark, small, name):
    path = public_tokenizers.path(name)
    full, mine = Tokenizer.from_file(path), tokenizer(read_spec(path))
    texts = ODD + [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choice("aB \n\t'.éİ1<|>") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    rows = iter(texts)
    for ids, ends in mine.slices(pa.array([*texts, None]), 9):
        for a, b in zip(ends, ends[1:]):
            assert ids[a:b].tolist() == [*full.encode(next(rows, ""), add_special_tokens=False).ids, 9]
    for t in texts:
        assert mine.ids(t).tolist() == full.encode(t, add_special_tokens=False).ids, t


def check_packing(rows, ids_of, capacity=2048):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for d, ids in ids_of:
        for i, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            want[d].append((i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    assert {d: sorted(x) for d, x in pieces.items()} == {d: sorted(x) for d, x in want.items()}
    return len(bins)


def test_query_packs_every_piece(spark, tmp_path):
    docs = documents(spark, clashing=True)
    rows = QUERIES["op1_best_fit_packing"](spark, save(tmp_path, spark, documents=docs)).collect()
    full = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = [(r["doc_id"], [*full.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in docs.collect()]
    n = check_packing(rows, ids)
    assert n == -(-sum(len(x) for _, x in ids) // 2048)  # as few as any packing can have


def test_empty_table(spark, tmp_path):
    d = save(tmp_path, spark, documents=empty(spark))
    assert QUERIES["op1_best_fit_packing"](spark, d).count() == 0 and QUERIES["op7_token_files"](spark, d).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_local_search_keeps_pieces_and_never_adds_bins(seed):
    rng = random.Random(seed)
    lengths = Counter(rng.randint(1, 100) if seed % 2 else rng.choice([34, 35, 51, 66]) for _ in range(400))
    first = packing.best_fit(lengths, 100)
    better = packing.improve(first, 100)
    assert sum(better.values()) <= sum(first.values())
    assert sum((Counter({x: k * n for x, k in Counter(p).items()}) for p, n in better.items()), Counter()) == lengths
    assert all(sum(p) <= 100 for p in better)


def test_exchanges_empty_a_bin():
    """Best fit leaves three bins; one exchange packs them into two."""
    bins = Counter({(6, 3): 1, (5, 3): 1, (2, 1): 1})
    assert sum(packing.improve(bins, 10).values()) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_search_reaches_a_known_optimum(seed):
    """3,000 full bins cut into four pieces each: best fit needs one more, the search does not."""
    rng, lengths = random.Random(seed), Counter()
    for _ in range(3000):
        cuts = [0, *sorted(rng.sample(range(1, 2048), 3)), 2048]
        lengths.update(b - a for a, b in zip(cuts, cuts[1:]))
    first = packing.best_fit(lengths, 2048)
    better = packing.improve(first, 2048)
    assert sum(first.values()) == 3001 and sum(better.values()) == 3000
    assert sum((Counter({x: k * n for x, k in Counter(p).items()}) for p, n in better.items()), Counter()) == lengths


def test_search_is_the_same_for_many_equal_bins():
    """Counts of a million bins cost no more than single ones."""
    bins = Counter({(6, 3): 10**6, (5, 3): 10**6, (2, 1): 10**6})
    assert sum(packing.improve(bins, 10).values()) == 2 * 10**6


def test_pieces_of_long_documents():
    assert packing.cut(0, 10) == [] and packing.cut(10, 10) == [(0, 10)] and packing.cut(25, 10) == [(0, 5), (5, 10), (15, 10)]


def test_token_files_round_trip(spark, tmp_path):
    docs = documents(spark, clashing=True)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op7_token_files"](spark, save(tmp_path, spark, documents=docs)).collect()), key=lambda r: r[2])
    full = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    each = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
    at, want = 0, []
    for known, d, text in each:
        ids = [*full.encode(text, add_special_tokens=False).ids, 1]
        want.append((known, d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_ids_above_sixteen_bits(spark, tmp_path):
    """A vocabulary whose ids do not fit 16 bits is written 32 bits wide."""
    import json

    spec = json.loads(read_spec(vocabulary("byte_bpe_50k.json")))
    spec["model"]["vocab"] = {w: i + (70_000 if i >= 300 else 0) for w, i in spec["model"]["vocab"].items()}
    spec["added_tokens"] = []
    at = tmp_path / "wide.json"
    at.write_text(json.dumps(spec))
    docs, full = documents(spark, 5), Tokenizer.from_file(str(at))
    path = new_path(spark, "wide")
    manifest = tokenfile.write_tokens(docs, str(at), 1, path)
    assert {m[5] for m in manifest} == {4}
    got = sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in tokenfile.read_tokens(spark, path, manifest, with_ids=True).collect())
    want = sorted([*full.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect())
    assert got == want and max(map(max, got)) > 65_535


def test_ids_come_back_from_files(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    path = new_path(spark, "t")
    manifest = tokenfile.write_tokens(docs, vocabulary("word_bpe_49k.json"), 1, path)
    full = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in tokenfile.read_tokens(spark, path, manifest, with_ids=True).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*full.encode(text[r["doc_id"]], add_special_tokens=False).ids, 1]
