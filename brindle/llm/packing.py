"""Best-fit packing of documents into fixed-size sequences, improved by swaps between underfull bins.

The plan depends only on how many pieces there are of each length: at most ``capacity`` numbers, whatever the corpus.
The driver packs that histogram (equal bins are one pattern with a count), improves it by local search (``Search``: moves
and exchanges of one for one and two for one between underfull bins, each raising the squared fill, until bins empty),
and lists for each pattern position which run of equal-length pieces goes there. Pieces are then numbered in order of length by a
range sort and per-partition bases, and each one looks up its place; no piece travels to the driver and no length,
however frequent, meets in one task.

Defined cases: a null text is empty (one piece that holds the end id alone); an empty table gives an empty result;
repeated rows are packed once each; ties in length are dealt in order of doc_id and piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .tokens import read_spec, tokenizer

#: Bins that the local search looks at, for each pattern of bins (of which a histogram has a few times ``capacity``).
STEPS = 600


def best_fit(lengths: dict[int, int], capacity: int) -> Counter:
    """Best-fit decreasing on a histogram: how many bins hold each pattern (lengths, descending)."""
    open_bins: dict[int, Counter] = {}
    spaces: list[int] = []

    def put(pattern: tuple, space: int, n: int) -> None:
        if space not in open_bins:
            open_bins[space] = Counter()
            spaces.insert(bisect_left(spaces, space), space)
        open_bins[space][pattern] += n

    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                pattern, n = next(iter(open_bins[space].items()))
            else:
                space, pattern, n = capacity, (), left
            each = min(space // length, left)  # a bin just filled stays the best fit while it has room
            used = min(n, left // each)
            if pattern or space != capacity:
                open_bins[space][pattern] -= used
                if not open_bins[space][pattern]:
                    del open_bins[space][pattern]
                if not open_bins[space]:
                    del open_bins[space]
                    spaces.pop(at)
            put(pattern + (length,) * each, space - length * each, used)
            left -= used * each
    return sum(open_bins.values(), Counter())


def pairs(pattern: tuple) -> list[tuple[int, int, int]]:
    """(sum, larger, smaller) of two pieces of a bin, one for each two lengths, in order of the sum."""
    each = Counter(pattern)
    own = sorted(each, reverse=True)
    return sorted((x + y, x, y) for i, x in enumerate(own) for y in own[i:] if x != y or each[x] > 1)


def without(pattern: tuple, pieces: tuple) -> tuple:
    rest = list(pattern)
    for x in pieces:
        rest.remove(x)
    return tuple(rest)


class Search:
    """Local search over bins, equal bins being one pattern with a count. Each trade raises the squared fill.

    The least filled bin is the source. A trade moves one of its pieces to another underfull bin, or exchanges one for
    one, two for one or one for two, so that the other bin gets fuller. Where no two bins can trade, room travels: a bin
    with room g exchanges with a third bin in one of these ways so that it is full and the third bin has the room, and so
    on, until the room is where the source has an exchange of just that size. A source that nothing can be taken from is
    left as it is, and the next least filled bin is the source. ``steps`` bounds the bins looked at.
    """

    def __init__(self, bins: Counter, capacity: int, steps: int | None = None):
        self.bins, self.capacity = Counter(), capacity
        self.holders: dict[int, dict[tuple, tuple]] = {}  # by length: the patterns that hold it
        self.pairs: dict[int, dict[tuple, tuple]] = {}  # by the sum of two lengths
        for p, n in bins.items():
            self.put(p, n)
        self.steps = STEPS * len(self.bins) if steps is None else steps
        self.least = -(-sum(sum(p) * n for p, n in bins.items()) // capacity)

    def put(self, p: tuple, n: int) -> None:
        """``n`` more (or fewer) bins of a pattern. An empty bin is none."""
        if not p:
            return
        self.bins[p] += n
        if self.bins[p] == n:
            for x in set(p):
                self.holders.setdefault(x, {})[p] = (x,)
            for total, x, w in pairs(p):
                self.pairs.setdefault(total, {})[p] = (x, w)
        elif not self.bins[p]:
            del self.bins[p]
            for x in set(p):
                del self.holders[x][p]
            for total, _, _ in pairs(p):
                self.pairs[total].pop(p, None)

    def trade(self, changes: list[tuple[tuple, list[int], list[int]]]) -> tuple:
        """Change bins of different patterns (pattern, pieces out, pieces in), as many times as there are bins of each
        pattern; returns what became of the first."""
        times, made = min(self.bins[p] for p, _, _ in changes), []
        for p, out, into in changes:
            made.append(tuple(sorted((*without((*p, *into), out),), reverse=True)))
        for (p, _, _), new in zip(changes, made):
            self.put(p, -times)
            self.put(new, times)
        return made[0]

    def direct(self, source: tuple, underfull: list[tuple]) -> tuple | None:
        """The first bin that can trade with the source takes what fills it best."""
        own, two = sorted(set(source)), pairs(source)
        for q in underfull:
            if self.steps <= 0:
                return None
            self.steps -= 1
            room, values, best = self.capacity - sum(q), sorted(set(q)), None

            def offer(gain: int, out: list[int], back: list[int], room=room):
                nonlocal best
                if 0 < gain <= room and (best is None or gain > best[0]):
                    best = (gain, out, back)

            if i := bisect_left(own, room + 1):
                offer(own[i - 1], [own[i - 1]], [])
            for x in own:
                if (i := bisect_left(values, x - room)) < len(values):
                    offer(x - values[i], [x], [values[i]])
            for total, x, w in two:
                if (i := bisect_left(values, total - room)) < len(values):
                    offer(total - values[i], [x, w], [values[i]])
            if best is None or best[0] < room:
                other = pairs(q)
                for x in own:
                    if (i := bisect_left(other, (x - room,))) < len(other):
                        offer(x - other[i][0], [x], list(other[i][1:]))
            if best:
                return self.trade([(source, best[1], best[2]), (q, best[2], best[1])])
        return None

    def travel(self, source: tuple, room: int, targets: list[tuple]) -> tuple | None:
        """Carry ``room`` of one of the targets (each has as much) through other bins to one where the source can fill it."""
        gifts = {x - room: [x] for x in sorted(set(source)) if x > room} | {total - room: [x, w] for total, x, w in pairs(source) if total > room}
        goals = {p for y in gifts for kind in (self.holders, self.pairs) for p in kind.get(y, ())}
        came, front = dict.fromkeys([*targets, source]), targets
        while front and self.steps > 0:
            new = []
            for at in front:
                held = without(at, came[at][2] if came[at] else ())
                ways = [(v, (v,), (self.holders, self.pairs)) for v in dict.fromkeys(held)] + [(0, (), (self.holders,))]
                ways += [(total, (v, w), (self.holders,)) for total, v, w in pairs(held)]
                for total, give, kinds in ways:
                    for kind in kinds:
                        for p, take in kind.get(total + room, {}).items():
                            if p in came:
                                continue
                            came[p] = (at, give, take)
                            new.append(p)
                            self.steps -= 1
                            if p in goals and (last := self.gift(gifts, without(p, take))):
                                return self.carry(source, p, *last, came)
            front = new
        return None

    @staticmethod
    def gift(gifts: dict[int, list[int]], held: tuple) -> tuple[list[int], tuple] | None:
        """(what the source gives, what it gets) in an exchange that fills the room just so."""
        for y in dict.fromkeys(held):
            if y in gifts:
                return gifts[y], (y,)
        for total, x, w in pairs(held):
            if len(gifts.get(total, "no")) == 1:
                return gifts[total], (x, w)
        return None

    def carry(self, source: tuple, last: tuple, gift: list[int], back: tuple, came: dict) -> tuple:
        out, into = {source: list(gift), last: list(back)}, {source: list(back), last: list(gift)}
        while came[last]:
            at, give, take = came[last]
            for p, minus, plus in ((last, take, give), (at, give, take)):
                out[p] = out.get(p, []) + list(minus)
                into[p] = into.get(p, []) + list(plus)
            last = at
        return self.trade([(x, out[x], into[x]) for x in out])

    def run(self) -> Counter:
        fill = lambda p: (sum(p), p)
        stuck, traded = set(), False
        while sum(self.bins.values()) > self.least and self.steps > 0:
            underfull = sorted((p for p in self.bins if sum(p) < self.capacity), key=fill, reverse=True)
            source = next((p for p in reversed(underfull) if p not in stuck), None)
            if source is None:  # each had its turn; trades since may have opened others
                if not traded:
                    break
                stuck, traded = set(), False
                continue
            others = [q for q in underfull if q != source and sum(q) >= sum(source)]
            rooms = [self.capacity - sum(q) for q in others]  # ascending
            if self.direct(source, others) is None and all(self.travel(source, x, others[bisect_left(rooms, x) :]) is None for x in dict.fromkeys(rooms)):
                stuck.add(source)
            else:
                traded = True
        return self.bins


def improve(bins: Counter, capacity: int, steps: int | None = None) -> Counter:
    """``bins`` after the local search; never more of them."""
    return Search(+Counter(bins), capacity, steps).run()


def plan(lengths: dict[int, int], capacity: int, steps: int | None = None) -> dict[str, np.ndarray]:
    """For each pattern position the run of pieces (numbered by length, shortest first) that goes there.

    ``first``: number of the run's first piece; its i-th piece goes to sequence ``base + i`` at ``offset``. ``bins``: how many
    sequences there are; ``least``: what no packing can go below.
    """
    bins = improve(best_fit(lengths, capacity), capacity, steps)
    runs, base = [], 0
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in pattern:
            runs.append((length, base, offset, n))
            offset += length
        base += n
    runs.sort(key=lambda r: r[0])
    first = np.concatenate([[0], np.cumsum([r[3] for r in runs])])[: len(runs)].astype(np.int64)
    return {"first": first, "base": np.array([r[1] for r in runs], np.int64), "offset": np.array([r[2] for r in runs], np.int64), "bins": base, "least": -(-sum(x * n for x, n in lengths.items()) // capacity)}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole capacities, and what is left over comes first."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of each document; ``with_ids`` adds the ids as little-endian unsigned 32-bit bytes."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches):
        t = tokenizer(spec.value)
        for b in batches:
            names, at = b.column(0), 0
            for ids, ends in t.slices(b.column(1), end_id):
                n = np.diff(ends)
                whole, head = n // capacity, n % capacity
                each = whole + (head > 0)  # pieces of a document; what is left over comes first
                owner = np.repeat(np.arange(len(n)), each)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
                short = head[owner] > 0
                start = np.where(short & (piece > 0), head[owner] + (piece - 1) * capacity, piece * capacity)
                length = np.where(short & (piece == 0), head[owner], capacity)
                raw, lo = memoryview(ids.astype("<u4").tobytes()), (ends[owner] + start) * 4
                blobs = [raw[x:y] for x, y in zip(lo.tolist(), (lo + length * 4).tolist())]
                arrays = [names.take(pa.array(at + owner)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(map(zlib.crc32, blobs), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(map(bytes, blobs), pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
                at += len(n)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def pack(pieces: DataFrame, capacity: int, order: tuple[str, ...] = ("doc_id", "piece"), steps: int | None = None) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (a ``length`` from 1 to capacity each); other columns stay.

    ``pieces`` should be a settled table: it is read once for the histogram and once for the range sort.
    """
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    if any(not 1 <= x <= capacity for x in lengths):
        raise ValueError("a piece is longer than a sequence, or empty")
    runs = plan(lengths, capacity, steps)
    numbered = settle(pieces.repartitionByRange("length", *order).sortWithinPartitions("length", *order).withColumn("_at", F.monotonically_increasing_id()), "packing")
    sizes = {r["p"]: r["n"] for r in numbered.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per partition
    base, seen = {}, 0
    for p in sorted(sizes):
        base[p], seen = seen, seen + sizes[p]
    names = pieces.columns

    def place(batches):
        parts = np.array(sorted(base), np.int64)
        bases = np.array([base[p] for p in sorted(base)], np.int64)
        for b in batches:
            at = b.column(b.schema.get_field_index("_at")).to_numpy()
            number = bases[np.searchsorted(parts, at >> 33)] + (at & ((1 << 33) - 1))
            run = np.searchsorted(runs["first"], number, side="right") - 1
            sequence, offset = runs["base"][run] + number - runs["first"][run], runs["offset"][run]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(sequence), pa.array(offset)], names + ["sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, **cols) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32 [, ids], sequence_id, offset."""
    return pack(settle(tokenize_pieces(docs, vocabulary, capacity, end_id, with_ids=with_ids, **cols), "pieces"), capacity)
