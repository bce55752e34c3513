"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

For each benchmark item a document's item-sized windows are the candidates. A window within the allowed share of word
edits leaves, by the pigeonhole principle, a short run of the item's words in place, so only windows at such runs, and
with enough of the item's words in them, are looked at: neither test loses a match. What is left is embedded by CGK
random walks (a walk repeats or passes each word by a random bit of the word and the step), which maps edit distance
to Hamming distance; tables sample positions of the walks, and a window that agrees with the item in any table is
verified by exact edit distance (over all ends of the window). The number of tables follows from the target recall: it
is measured once on edited copies of a sample of all items (``TRIED`` at most, picked by hash), where table count doubles
until the target is reached. Should ``TABLES`` not reach it, every candidate window is verified, which loses none.

The documents are read where they lie: no shuffle, no pairs of documents. Items come to the executors in blocks of
bounded size (``BLOCK_WORDS``); with more, further passes are made, none is left out. Walks follow the words' own hashes
and the one number of tables, so what is found does not depend on the blocks.

Defined cases: null or wordless items match nothing; an item without an id is looked for like any other and reported
with a null id; of items with equal ids each is looked for; a null text holds no item; letters' case and ASCII
punctuation do not count; items of fewer words than five must occur exactly; a text of any length is read whole;
repeated rows are judged alike; an empty table of documents or items gives rows without items; other columns stay.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Words of benchmark items that are shared with the executors at once.
BLOCK_WORDS = 2_000_000
#: Edits allowed, as a share of an item's words; sampled positions of a table; recall to reach; tables at most.
EDITS, SAMPLED, RECALL, TABLES = 0.2, 3, 0.99, 256
#: Items on whose edited copies recall is measured, and copies made in all.
TRIED, COPIES = 400, 1000

_CLEAR = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_CLEAR).split()


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def codes(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same wherever the word stands."""
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w, 11) or 1 for w in words), np.uint64, len(words))


def edit_distance(item: list, text: list, most: int) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``text`` nearest to ``item``; distance most + 1 if none is near."""
    row, starts = [0] * (len(text) + 1), list(range(len(text) + 1))
    for i, x in enumerate(item, 1):
        new, at = [i], [0]
        for j, y in enumerate(text, 1):
            best, s = row[j - 1] + (x != y), starts[j - 1]
            if row[j] + 1 < best:
                best, s = row[j] + 1, starts[j]
            if new[j - 1] + 1 < best:
                best, s = new[j - 1] + 1, at[j - 1]
            new.append(best)
            at.append(s)
        row, starts = new, at
        if min(row) > most:
            return most + 1, 0, 0
    end = min(range(len(row)), key=lambda j: (row[j], abs(j - starts[j] - len(item))))
    return row[end], starts[end], end


class Items:
    """Benchmark items as numbers, seeds and walks."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], edits: float = EDITS, tables: int = 8):
        """``tables``: as ``choose`` has it for all items; 0: every candidate is verified."""
        self.ids, self.tables = [i for i, w in items if w], tables
        texts = [w for _, w in items if w]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(x for t in texts for x in t), 1)}
        self.texts = [np.array([self.vocabulary[x] for x in t], np.int64) for t in texts]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.array([int(edits * n) if n >= 5 else 0 for n in self.size], np.int64)
        self.wide = len(self.vocabulary) + 1
        self.held = np.unique(np.concatenate([i * self.wide + t for i, t in enumerate(self.texts)])) if self.texts else np.zeros(0, np.int64)
        self.seeds: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        runs = [min(3, n, -(-(n - k) // (k + 1))) for n, k in zip(self.size.tolist(), self.most.tolist())]
        for length in sorted(set(runs)):
            rows = [(h, i, q) for i, r in enumerate(runs) if r == length for q, h in enumerate(self.rolled(self.texts[i], length).tolist())]
            h = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(h, kind="stable")
            self.seeds.append((length, h[order], np.array([r[1] for r in rows], np.int64)[order], np.array([r[2] for r in rows], np.int64)[order]))
        self.sift = {}
        for length, h, _, _ in self.seeds:
            table = np.zeros(1 << 20, bool)
            table[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.sift[length] = table
        self.codes = [codes(t) for t in texts]
        self.keys = self.embed(np.arange(len(self.texts)), self.codes, tables) if self.ids and tables else None

    def member(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether the items hold the words: a search among the (item, word) pairs, whose number is that of the words."""
        wanted = item * self.wide + word
        return self.held[np.minimum(np.searchsorted(self.held, wanted), len(self.held) - 1)] == wanted

    @staticmethod
    def rolled(words: np.ndarray, length: int) -> np.ndarray:
        n = max(0, len(words) - length + 1)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(length):
                h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n].astype(np.uint64)
        return mix(h)

    def embed(self, item: np.ndarray, windows: list[np.ndarray], tables: int) -> np.ndarray:
        """Table keys of windows (as ``codes``): each table walks on its own and samples positions of the item's size."""
        if len(windows) > 2000:
            return np.concatenate([self.embed(item[i : i + 2000], windows[i : i + 2000], tables) for i in range(0, len(windows), 2000)])
        wide = int(self.size[item].max(initial=1))
        padded = np.zeros((len(windows), wide + 1), np.uint64)
        for r, w in enumerate(windows):
            padded[r, : min(len(w), wide)] = w[:wide]
        rows, size, number = np.arange(len(windows))[:, None], self.size[item][:, None], np.arange(1, tables + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            seed, spread = number * np.uint64(0x9E3779B9), padded * np.uint64(0x2545F4914F6CDD1D)
            picks = mix(number[:, None] * np.uint64(131) + np.arange(SAMPLED, dtype=np.uint64)) % np.uint64(1 << 20)
            wanted = (picks.astype(np.float64) / (1 << 20) * 2 * size[:, :, None]).astype(np.int64)
            at, key = np.zeros((len(windows), tables), np.int64), np.zeros((len(windows), tables), np.uint64)
            for step in range(int(wanted.max(initial=0)) + 1):
                now = np.minimum(at, size)
                hit = (wanted == step).any(2)
                if hit.any():
                    key = np.where(hit, mix(key * np.uint64(31) + padded[rows, now] + np.uint64(step + 7)), key)
                at += (mix(spread[rows, now] + seed * np.uint64(step + 1)) & np.uint64(1)).astype(np.int64)
        return key

    def choose(self, recall: float) -> tuple[int, float]:
        """(tables that reach the recall on copies with as many random edits as allowed, seeds' starts being tried; the
        recall reached). No tables: ``TABLES`` do not reach it. Words are exchanged for other items' and for unknown ones."""
        if not self.ids:
            return 1, 1.0
        rng, tries, item = np.random.default_rng(5), [], []
        pool, unknown = np.concatenate(self.codes), np.uint64(1)
        known = {int(c): n for t, w in zip(self.texts, self.codes) for c, n in zip(w, t)}
        for _ in range(-(-COPIES // len(self.texts))):
            for i, t in enumerate(self.codes):
                w = t.tolist()
                for _ in range(int(self.most[i])):
                    at, kind, new = int(rng.integers(len(w))), int(rng.integers(3)), int(rng.choice(pool) if rng.integers(2) else unknown)
                    if kind == 0:
                        w[at] = new
                    elif kind == 1:
                        w.insert(at, new)
                    elif len(w) > 1:
                        del w[at]
                tries.append(np.array(w, np.uint64))
                item.append(i)
        item = np.array(item)
        starts = [(j, o) for j, w in enumerate(tries) for o in self.offsets(item[j], np.array([known.get(int(x), 0) for x in w], np.int64))]
        windows = [tries[j][o:] if o >= 0 else np.concatenate([np.zeros(-o, np.uint64), tries[j]]) for j, o in starts]
        owner, tables = np.array([j for j, _ in starts], np.int64), 8
        while True:
            mine, own = self.embed(item[owner], windows, tables), self.embed(np.arange(len(self.texts)), self.codes, tables)
            hit = (mine == own[item[owner]]).any(1)
            got = len(np.unique(owner[hit])) / len(tries)
            if got >= recall:
                return tables, got
            if tables >= TABLES:
                return 0, 1.0
            tables *= 2

    def offsets(self, i: int, words: np.ndarray) -> list[int]:
        """Where the item would start in ``words``, by its seeds."""
        out = set()
        for length, h, own, q in self.seeds:
            rolled = self.rolled(words, length)
            lo, hi = np.searchsorted(h, rolled, "left"), np.searchsorted(h, rolled, "right")
            for p in np.flatnonzero(hi > lo):
                out.update(int(p - q[x]) for x in range(lo[p], hi[p]) if own[x] == i)
        return sorted(o for o in out if o > -self.size[i])

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """Per text its verified items: (item_id, first word, end word, distance), the nearest stretch of each."""
        out: list[dict] = [{} for _ in texts]
        if not self.ids:
            return [[] for _ in texts]
        get, parts, ends = self.vocabulary.get, [], []
        total = 0
        held = [words_of(t) for t in texts]
        for w in held:
            parts.append(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)))
            total += len(w) + 1
            ends.append(total)
        stop = np.array([-1], np.int64)
        words = np.concatenate([x for p in parts for x in (p, stop)]) if parts else np.zeros(0, np.int64)
        ends = np.array(ends, np.int64)
        found = []
        for length, h, own, q in self.seeds:
            rolled = self.rolled(words, length)
            known = words > 0
            usable = self.sift[length][(rolled & np.uint64((1 << 20) - 1)).astype(np.int64)]
            for j in range(length):
                usable &= known[j : j + len(usable)]
            at = np.flatnonzero(usable)
            lo, hi = np.searchsorted(h, rolled[at], "left"), np.searchsorted(h, rolled[at], "right")
            n = hi - lo
            if n.sum():
                spread = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                where = np.repeat(at, n)
                found.append(np.stack([np.searchsorted(ends, where, "right"), own[spread], where - q[spread]], 1))
        if not found:
            return [[] for _ in texts]
        cand = np.unique(np.concatenate(found), axis=0)
        for lo in range(0, len(cand), 20_000):
            self.verify(cand[lo : lo + 20_000], words, ends, held, out)
        return [[(self.ids[i], s, e, d) for i, (d, s, e) in sorted(x.items())] for x in out]

    def verify(self, cand: np.ndarray, words: np.ndarray, ends: np.ndarray, held: list[list[bytes]], out: list[dict]) -> None:
        doc, item, start = cand.T
        first, last = np.where(doc > 0, ends[doc - 1], 0), ends[doc] - 1
        size, most = self.size[item], self.most[item]
        lo, hi = np.maximum(start - most, first), np.minimum(start + size + most, last)
        enough = np.zeros(len(cand), np.int64)
        for j in range(int((hi - lo).max(initial=0))):  # how many words of the item the stretch holds
            inside = lo + j < hi
            enough += inside & self.member(item, np.maximum(words[np.minimum(lo + j, len(words) - 1)], 0))
        keep = np.flatnonzero(enough >= size - most)
        if not len(keep):
            return
        hit = keep
        if self.tables:
            windows = []
            for c in keep.tolist():
                a, b, z = int(max(start[c], first[c])), int(min(start[c] + size[c], last[c])), int(first[c])
                windows.append(np.concatenate([np.zeros(int(max(0, z - start[c])), np.uint64), codes(held[doc[c]][a - z : b - z])]))
            hit = keep[(self.embed(item[keep], windows, self.tables) == self.keys[item[keep]]).any(1)]
        for c in hit.tolist():
            d, i, k = int(doc[c]), int(item[c]), int(most[c])
            a, b = int(max(first[c], start[c] - k)), int(hi[c])
            if i in out[d] and out[d][i][0] == 0:
                continue
            got, s, e = edit_distance(self.texts[i].tolist(), words[a:b].tolist(), k)
            if got <= k:
                mine = (got, a + s - int(first[c]), a + e - int(first[c]))
                out[d][i] = min(out[d].get(i, mine), mine)


SPANS = "array<struct<item_id:bigint,first_word:bigint,end_word:bigint,distance:bigint>>"
_KIND = pa.list_(pa.struct([(x, pa.int64()) for x in ("item_id", "first_word", "end_word", "distance")]))


def find_items(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "leaks") -> DataFrame:
    """``docs`` with a column ``into`` added: the benchmark items in each text, with their places and distances."""
    spark, plain = docs.sparkSession, docs.drop(into)
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    key = F.xxhash64("i", "t")
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("t"))).first()[0] or 0) / 4 / BLOCK_WORDS))
    tried = items.orderBy(key, "t").limit(TRIED).collect()
    tables, _ = Items([(r[0], words_of(r[1])) for r in tried], edits).choose(recall)
    out = plain.withColumn(into, F.expr(f"cast(array() as {SPANS})"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + f", `{into}` {SPANS}"
    at, width = plain.columns.index(text_col), len(plain.columns)
    for block in range(blocks):
        rows = sorted(items.where(F.pmod(key, F.lit(blocks)) == block).collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        shared = spark.sparkContext.broadcast(Items([(r[0], words_of(r[1])) for r in rows], edits, tables))

        def run(batches, shared=shared):
            for b in batches:
                for lo in range(0, max(1, b.num_rows), 256):
                    part = b.slice(lo, 256)
                    found = shared.value.matches(part.column(at).to_pylist())
                    rows = [old + [dict(zip(("item_id", "first_word", "end_word", "distance"), x)) for x in new] for old, new in zip(part.column(width).to_pylist(), found)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(rows, _KIND)], b.schema.names)

        out = out.mapInArrow(run, fields)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    (into,) = fresh(docs, "leaks")
    return find_items(docs, benchmark, into=into, **options).where(F.size(into) == 0).drop(into)
