"""Near copies by SimHash and exact shingle similarity: what the pipeline's near-dedup stage removes.

The ``op3`` query links fingerprints within 2 of 64 bits. Texts of Jaccard similarity 0.8 differ in about 15 % of their
bits, a radius at which no vantage divides a whole fingerprint; so the stage looks at many short ones.

1. Each text is the set of its word shingles (64-bit hashes); texts of equal sets are one point from there on. A bit of
   its SimHash is the sign of the sum of its shingles' weights (-7/2 to 7/2, of each shingle and bit; the sums of one
   bit a shingle would be tied too often in short texts). At ties the least shingle decides.
2. A fingerprint is ``CHECK`` bits and ``TREES`` codes of ``CODE`` bits. Each code has a vantage-point tree of its own,
   searched at ``RADIUS`` as in ``simhash``: visits by the triangle bound, so no pair within the radius is missed. Such
   pairs are candidates if their ``CHECK`` bits differ in ``FAR`` at most, which unlike texts hardly ever do. Sets of
   similarity 0.8 meet in none of the trees with probability 0.0001, and 0.0004 for sets of four and five shingles.
3. Candidates joined over all trees make a group. All pairs of a group are compared by their sets, in pairs of blocks
   of about ``BLOCK`` points that are dealt over tasks; a task returns a spanning forest of its links, never all pairs.
4. Forests are joined as in ``simhash``.

Points travel to the trees in packed blocks, 20 bytes a point and tree. A tree of up to ``SHARD`` points is one task's;
a larger one is dealt by vantages from a bounded sample, on which the result does not depend.

Defined cases: words and case as in ``simhash``; texts without words are one point; a text of fewer words than a shingle
is one shingle.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .simhash import best_split, build_tree, route, stars

#: Words of a shingle, and the least similarity of near copies as a fraction.
WORDS, SIMILAR = 5, (4, 5)
#: Codes and their bits, bits that candidates' codes may differ in; bits to tell unlike texts, and how many may differ.
TREES, CODE, RADIUS, CHECK, FAR = 48, 20, 1, 128, 40
#: Points of a tree that one task searches, of a cell of a shard that no vantage divides, compared in full in a search;
#: fingerprints that the driver may gather to place vantage points.
SHARD, CELL, LEAF, TREE_SAMPLE = 1 << 18, 1 << 15, 512, 32_768
#: Points of a group that are compared in full with as many others in one task.
BLOCK = 256

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a weight, and for each of them as many hashes as a fingerprint has words.
_PLANES, _LONGS = 3, (TREES * CODE + CHECK) // 64
_ODD = np.random.default_rng(42).integers(0, 1 << 63, _PLANES * _LONGS, np.uint64) * np.uint64(2) + np.uint64(1)
#: A point as a tree's task sees it.
_SEEN = np.dtype([("code", "<u4"), ("fp", "<u8"), ("more", "<u8")])


@lru_cache(1 << 16)
def _word(w: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(w, 42)


def _fold(state: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        state = (state ^ x) * _MIX
    return state ^ (state >> np.uint64(29))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles; none for a text without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word, w), np.uint64, len(w))
    size = min(len(w), words)
    n = len(w) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = _fold(out, h[j : j + n])
    return np.unique(out)


def set_key(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(s.tobytes(), 42)).view(np.int64))


def fingerprint(s: np.ndarray) -> np.ndarray:
    """The SimHash bits of a set that is not empty."""
    total = np.zeros(_PLANES * _LONGS * 64, np.int64)
    for lo in range(0, len(s), 255):
        x = s[lo : lo + 255, None] * _ODD
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(32)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.uint8)
        if not lo:
            least = bits[0].reshape(_PLANES, -1)[-1]
    doubled = 2 * (total.reshape(_PLANES, -1) << np.arange(_PLANES)[:, None]).sum(0) - len(s) * ((1 << _PLANES) - 1)
    return np.where(doubled == 0, least, doubled > 0).astype(np.uint8)


def packed(bits: np.ndarray) -> bytes:
    """The ``CHECK`` bits, then each code in four bytes."""
    codes = np.zeros((TREES, 32), np.uint8)
    codes[:, :CODE] = bits[CHECK:].reshape(TREES, CODE)
    return np.packbits(bits[:CHECK], bitorder="little").tobytes() + np.packbits(codes, axis=1, bitorder="little").tobytes()


def opened(prints: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the two longs of the ``CHECK`` bits, the codes) of packed fingerprints, a row each."""
    raw = np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(len(prints), CHECK // 8 + 4 * TREES)
    return np.ascontiguousarray(raw[:, : CHECK // 8]).view("<u8"), np.ascontiguousarray(raw[:, CHECK // 8 :]).view("<u4")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash), key (of the shingle set), fp and print (the fingerprint's first long, and packed; null
    without words)."""

    def run(batches):
        for b in batches:
            keys, prints, known = [], [], {}
            for text in b.column(2).to_pylist():
                s = shingles(text)
                keys.append(key := set_key(s))
                if key not in known:
                    known[key] = packed(fingerprint(s)) if len(s) else None
                prints.append(known[key])
            first = pa.array([x and int.from_bytes(x[:8], "little", signed=True) for x in prints], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(keys, pa.int64()), first, pa.array(prints, pa.binary())], ["doc_id", "h", "key", "fp", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, key long, fp long, print binary")


def near(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between ``fp`` of the points, enough of them to connect all candidates among them."""
    code, fp, more = (np.ascontiguousarray(seen[c]) for c in _SEEN.names)
    up = np.arange(len(code))

    def top(x: np.ndarray) -> np.ndarray:
        x = up[x]
        while ((y := up[x]) != x).any():
            x = y
        return x

    def compare(which: np.ndarray) -> None:
        p, own = code[which], top(which)
        i, j = np.nonzero((np.bitwise_count(p[:, None] ^ p[None, :]) <= RADIUS) & (own[:, None] < own[None, :]))
        a, b = which[i], which[j]
        alike = np.bitwise_count(fp[a] ^ fp[b]) + np.bitwise_count(more[a] ^ more[b]) <= FAR
        x, y = own[i[alike]], own[j[alike]]
        while (x != y).any():
            np.minimum.at(up, x, np.minimum(x, y))
            np.minimum.at(up, y, np.minimum(x, y))
            x, y = top(x), top(y)

    def down(which: np.ndarray) -> None:
        if len(which) <= LEAF:
            return compare(which)
        split = best_split(code[which].astype(np.uint64), RADIUS)
        if split is None:  # a dense cloud that no vantage divides: leaves against leaves
            leaves = np.array_split(which, -(-len(which) // (LEAF // 2)))
            for i, a in enumerate(leaves):
                for b in leaves[i + 1 :]:
                    compare(np.concatenate([a, b]))
            return None
        d = np.bitwise_count(code[which] ^ np.uint32(split[0]))
        down(which[d <= split[1] + RADIUS])
        return down(which[d > split[1]])

    every = np.arange(len(code))
    down(every)
    u, v = fp, fp[top(every)]
    return u[u != v].view(np.int64), v[u != v].view(np.int64)


def search(points: DataFrame) -> DataFrame:
    """u, v: ``fp`` (the first 64 ``CHECK`` bits) of candidates, enough of them to connect all of the points' candidates."""
    n, sample = points.count(), np.zeros((0, TREES), np.uint32)
    if n > SHARD:
        mask = (1 << 30) - 1
        picked = points.where(F.xxhash64("key").bitwiseAND(F.lit(mask)) < F.lit(int(min(1.0, TREE_SAMPLE / n) * mask) + 1)).select("print")
        sample = opened(pa.array([bytes(r[0]) for r in picked.collect()], pa.binary()))[1]
    trees = []
    for t in range(TREES):
        nodes, dense = build_tree(np.sort(sample[:, t]).astype(np.uint64), n / SHARD, RADIUS)
        trees.append((nodes, np.array([max(1, round(x * SHARD / CELL)) if x > 1.5 else 1 for x in dense], np.int64)))

    def deal(batches):
        for b in batches:
            check, codes = opened(b.column(0))
            for t, (nodes, cells) in enumerate(trees):
                shard, which = route(nodes, codes[:, t].astype(np.uint64), RADIUS)
                times = cells[shard]
                with np.errstate(over="ignore"):
                    own = (((check[which, 0] * _MIX) >> np.uint64(33)).astype(np.int64) % times).repeat(times)
                other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                shard, which = np.repeat(shard, times), np.repeat(which, times)
                place = np.stack([shard, np.minimum(own, other), np.maximum(own, other)])
                order = np.lexsort(place[::-1])
                place, which = place[:, order], which[order]
                seen = np.empty(len(which), _SEEN)
                seen["code"], seen["fp"], seen["more"] = codes[which, t], check[which, 0], check[which, 1]
                starts = np.flatnonzero(np.r_[True, (place[:, 1:] != place[:, :-1]).any(0)][: len(which)])
                data = pa.array([x.tobytes() for x in np.split(seen, starts[1:])] if len(which) else [], pa.binary())
                at = [pa.array(x, pa.int32()) for x in (np.full(len(starts), t), *place[:, starts])]
                yield pa.RecordBatch.from_arrays([*at, data], ["tree", "shard", "a", "b", "seen"])

    def run(t: pa.Table) -> pa.Table:
        u, v = near(np.frombuffer(b"".join(t.column("seen").to_pylist()), _SEEN))
        return pa.table({"u": u, "v": v})

    dealt = points.select("print").mapInArrow(deal, "tree int, shard int, a int, b int, seen binary")
    return dealt.groupBy("tree", "shard", "a", "b").applyInArrow(run, "u long, v long")


def candidates(points: DataFrame) -> DataFrame:
    """key, first_id, root, n: the points in groups of two or more (n of them) that the search joins."""
    worded = points.where("print is not null")
    star = stars(search(worded)).select(F.col("u").alias("fp"), F.col("v").alias("top"))
    rooted = worded.select("key", "first_id", "fp").join(star, "fp", "left").select("key", "first_id", F.coalesce("top", "fp").alias("root"))
    rooted = settle(rooted, "rooted")
    sizes = settle(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")  # a join that Spark can split
    return settle(rooted.join(sizes, "root"), "members")


def forest(sets: list[np.ndarray], rows: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the links between the ``rows`` and all of ``sets`` (none of them empty)."""
    sizes = np.array([len(s) for s in sets])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    near, flag = np.zeros((len(sets), len(sets)), bool), np.zeros(len(values), bool)
    for r in rows:
        own = ids[starts[r] : starts[r] + sizes[r]]
        flag[own] = True
        both = np.add.reduceat(flag[ids], starts, dtype=np.int64)
        flag[own] = False
        near[r] = both * sum(SIMILAR) >= SIMILAR[0] * (sizes[r] + sizes)
    near |= near.T
    edges, seen = [], np.zeros(len(sets), bool)
    for s in range(len(sets)):
        if seen[s]:
            continue
        seen[s] = True
        front = np.array([s])
        while len(front):
            new = near[front].any(0) & ~seen
            seen |= new
            front = np.flatnonzero(new)
            edges.extend((int(j), s) for j in front)
    return edges


def links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """u, v: keys of near copies, enough of them to connect all that are linked inside a group."""
    sized = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("first_id"), "text").join(sized, "first_id").select("key", "root", "blocks", "text")

    def cut(batches):
        for b in batches:
            sets = [shingles(t) for t in b.column(3).to_pylist()]
            same = pa.array([set_key(s) == k for s, k in zip(sets, b.column(0).to_pylist())], pa.bool_())
            out = pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "root", "blocks", "hashes"])
            yield out.filter(same)

    cells = texts.mapInArrow(cut, "key long, root long, blocks int, hashes binary")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "key", "hashes")

    def compare(batches):
        at, held = None, {}

        def found():
            if len(held) < 2:
                return
            keys = list(held)
            rows = np.array([i for i, k in enumerate(keys) if held[k][0] == at[1]], np.int64)
            edges = forest([np.frombuffer(held[k][1], np.uint64) for k in keys], rows)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in edges]), pa.array([keys[j] for _, j in edges])], ["u", "v"])

        for b in batches:
            for root, x, y, mine, key, hashes in zip(*[c.to_pylist() for c in b.columns]):
                if (root, x, y) != at:
                    yield from found()
                    at, held = (root, x, y), {}
                held[key] = (mine, hashes)
        yield from found()

    return cells.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(compare, "u long, v long")


def first_of_each(docs: DataFrame) -> DataFrame:
    """doc_id, h: the least of each group of near copies in ``docs`` (without null doc_ids), with its text's xxhash64."""
    prints = settle(sketches(docs), "sketches")
    least = prints.groupBy("key").agg(F.min(F.struct("doc_id", "h", "fp", "print")).alias("x"))
    points = settle(least.select("key", F.col("x.doc_id").alias("first_id"), "x.h", "x.fp", "x.print"), "points")
    star = stars(links(docs, candidates(points.drop("h")))).select(F.col("u").alias("key"), F.col("v").alias("root"))
    grouped = points.join(star, "key", "left").groupBy(F.coalesce("root", "key").alias("root"))
    return grouped.agg(F.min(F.struct(F.col("first_id").alias("doc_id"), "h")).alias("x")).select("x.*").distinct()
