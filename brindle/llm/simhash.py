"""SimHash near-duplicates by vantage-point trees over Hamming distance.

1. Each text's fingerprint is computed once and settled with its doc_id; equal fingerprints are one point from there on.
2. A tree is built on the driver from a bounded sample of points (``TREE_SAMPLE``). It only deals points to shards, so
   results do not depend on the sample. At a node with vantage v and radius m, a point at distance d goes left if
   d <= m and right otherwise; a right point with d <= m + r also visits the left shard. By the triangle inequality two
   points within r of each other then always share a shard, so every link is found.
3. Within a shard the same rule is applied again down to blocks of ``BLOCK`` points, which are compared in full. A
   shard returns a spanning forest of its links, never all pairs. A shard that no vantage divides (a dense cloud of
   distinct points) is cut into cells of ``CELL`` points by hash, and each pair of cells is a task of its own.
4. Forests are joined by alternating large-star and small-star steps, each settled in the shared folder.

Defined cases: a null text is empty; texts without words have fingerprint zero and link like any other; a text of fewer
words than a shingle is one shingle; repeated rows stay, each with its component; a null doc_id stays and never names
a component unless all its rows lack one (then null); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Fingerprints that the driver may gather to place vantage points (8 bytes each).
TREE_SAMPLE = 131_072
#: Points of a shard that the tree aims at, of a cell of a dense shard, and points that are compared in full.
SHARD, CELL, BLOCK = 2048, 8192, 512


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half the XXH64 hashes of the text's word shingles."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    if len(w) <= words:
        return xxh64_intdigest(b" ".join(w), seed)
    joined = memoryview(b" ".join(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, votes = len(w) - words + 1, np.zeros(64, np.int64)
    spans = list(zip(starts[:n].tolist(), ends[words - 1 :].tolist()))
    for lo in range(0, n, 1 << 16):
        part = spans[lo : lo + (1 << 16)]
        h = np.fromiter([xxh64_intdigest(joined[a:b], seed) for a, b in part], np.uint64, len(part))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a long."""

    def run(batches):
        for b in batches:
            h = np.array([fingerprint(t, words, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def distance(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def best_split(points: np.ndarray, radius: int, tries: int = 6) -> tuple[int, int] | None:
    """A vantage and a distance that halve ``points`` well and leave few of them in the overlap."""
    best, found = None, None
    for v in points[np.linspace(0, len(points) - 1, tries).astype(int)]:
        counts = np.cumsum(np.bincount(distance(points, v), minlength=66 + radius))
        for m in range(64):
            left, both = counts[m], counts[m + radius] - counts[m]
            right = len(points) - left
            if not left or not right:
                continue
            cost = ((left + both) ** 2 + right**2) / len(points) ** 2
            if best is None or cost < best:
                best, found = cost, (int(v), m)
    return found if found and best < 0.9 else None


def build_tree(sample: np.ndarray, shards: float, radius: int) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """(nodes (vantage, distance, left, right), a child below zero being the shard -1 - child; for each shard how many
    shards' points it is expected to hold if no vantage divides it, else 1)."""
    nodes: list = []
    dense: list[float] = []

    def grow(points: np.ndarray, want: float) -> int:
        split = best_split(points, radius) if want > 1.5 and len(points) >= 16 else None
        if split is None:
            dense.append(want if len(points) >= 16 else 1.0)
            return -len(dense)
        at = len(nodes)
        nodes.append(None)
        d = distance(points, split[0])
        left, right = grow(points[d <= split[1]], want * (d <= split[1]).mean()), grow(points[d > split[1]], want * (d > split[1]).mean())
        nodes[at] = (*split, left, right)
        return at

    root = grow(sample, shards)
    return nodes or [(0, 64, root, root)], dense


def route(nodes: list, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, index of the point): a point's own shard, and those it visits."""
    shards, found = [], []

    def down(at: int, which: np.ndarray) -> None:
        if not len(which):
            return
        if at < 0:
            shards.append(np.full(len(which), -1 - at, np.int32))
            found.append(which)
            return
        v, m, left, right = nodes[at]
        d = distance(points[which], v)
        down(left, which[d <= m + radius])
        if right != left:
            down(right, which[d > m])

    down(0, np.arange(len(points)))
    return (np.concatenate(shards), np.concatenate(found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))


def forest(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, centre) of the link components among distinct points."""
    edges: list[tuple[int, int]] = []

    def compare(which: np.ndarray) -> None:
        p = points[which]
        near = np.bitwise_count(p[:, None] ^ p[None, :]) <= radius
        linked = np.flatnonzero(near.sum(1) > 1)
        seen = np.zeros(len(p), bool)
        for s in linked:
            if seen[s]:
                continue
            seen[s] = True
            front = np.array([s])
            while len(front):
                new = near[front].any(0) & ~seen
                seen |= new
                front = np.flatnonzero(new)
                edges.extend((int(which[j]), int(which[s])) for j in front)

    def down(which: np.ndarray) -> None:
        if len(which) <= BLOCK:
            return compare(which)
        split = best_split(points[which], radius)
        if split is None:  # a dense cloud that no vantage divides: blocks against blocks
            blocks = np.array_split(which, -(-len(which) // BLOCK))
            for i, a in enumerate(blocks):
                for b in blocks[i:]:
                    compare(a if a is b else np.concatenate([a, b]))
            return None
        d = distance(points[which], split[0])
        down(which[d <= split[1] + radius])
        return down(which[d > split[1]])

    down(np.arange(len(points)))
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    pairs = np.array([(x, top(x)) for x in up], np.int64).reshape(-1, 2)
    return points[pairs[:, 0]], points[pairs[:, 1]]


def link_edges(points: DataFrame, n: int, radius: int) -> DataFrame:
    """u, v: links among the distinct ``fp`` of ``points``, enough of them to connect what is within ``radius``."""
    mask = (1 << 30) - 1
    share = min(1.0, TREE_SAMPLE / max(n, 1))
    picked = points.where(F.xxhash64("fp").bitwiseAND(F.lit(mask)) < F.lit(int(share * mask) + 1)).collect()
    nodes, dense = build_tree(np.sort(np.array([r[0] for r in picked], np.int64)).view(np.uint64), n / SHARD, radius)
    cells = np.array([max(1, round(x * SHARD / CELL)) for x in dense], np.int64)

    def deal(batches):
        for b in batches:
            p = b.column(0).to_numpy().view(np.uint64)
            shard, which = route(nodes, p, radius)
            p, times = p[which], cells[shard]
            with np.errstate(over="ignore"):
                own = (((p ^ (p >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % times
            own, other = np.repeat(own, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            keys = (np.repeat(shard, times), np.minimum(own, other), np.maximum(own, other))
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), pa.array(np.repeat(p, times).view(np.int64))], ["shard", "a", "b", "fp"])

    def search(t: pa.Table) -> pa.Table:
        u, v = forest(t.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return points.mapInArrow(deal, "shard int, a int, b int, fp long").groupBy("shard", "a", "b").applyInArrow(search, "u long, v long")


def stars(edges: DataFrame) -> DataFrame:
    """u, v: each node but a component's least one, with that least one. Alternating large-star and small-star."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    e = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    was = state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")
        large = settle(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = settle(small, "edges")
        if (now := state(e)) == was:
            break
        was = now
    return e


def components(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Add component_id, the least doc_id reachable over links, to ``prints`` (doc_id, fp; a settled table)."""
    points = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "points")
    n = points.count()
    star = stars(link_edges(points.select("fp"), n, radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    linked = settle(star.unionByName(star.select(F.col("root").alias("fp"), "root").distinct()), "linked")
    least = settle(linked.join(points, "fp").groupBy("root").agg(F.min("first_id").alias("component_id")), "roots")
    named = linked.join(least, "root").select("fp", "component_id")
    named = settle(points.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "named")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``."""
    prints = settle(fingerprints(docs, words, id_col, text_col), "prints")
    return components(prints, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
