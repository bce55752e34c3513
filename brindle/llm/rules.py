"""Quality rules with an isolation forest on rule statistics.

Each text's rule statistics are computed once and settled. Labelled good rows (a bounded sample) give each statistic's
usual range, narrowed towards the middle for short texts, whose ratios are noisy. What a text is off those ranges by
are the forest's inputs: trees split them at random, and texts that few splits isolate have short paths and a high
anomaly score. The threshold is calibrated over all labelled rows, by a histogram of their scores.

Defined cases: a null text has no words (base_failed); null labels are left out, repeated labels of a document count
once by their mean, ties are left out; of rows with equal ids the one with the least features is fitted on; without
labels of both kinds the forest rejects nothing; repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .ranking import gathered, labelled, one_label
from .textstats import FEATURES, base_rules, features

#: Labelled rows that fitting gathers at most; trees, rows of a tree, depth.
SAMPLE, TREES, TREE_ROWS, DEPTH = 20_000, 150, 256, 8
#: Share of good rows outside a statistic's range on either side; words at which a text's ratios count half.
TAIL, HALF = 0.002, 50
#: Good rows lost weigh so many times as much as poor rows kept; bins of the calibration.
LOSS, BINS = 10.0, 2000

STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x binary"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base rules' statistics of each row, and its features as 32-bit floats."""

    def run(batches):
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base = base_rules(t)
                rows.append((d, *base, features(t, base[4]).tobytes()))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.binary())], [f.split()[0] for f in STATS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, STATS)


def path_left(n: int) -> float:
    """Mean path length that n rows would still take."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


class Forest:
    def __init__(self, x: np.ndarray, good: np.ndarray, seed: int = 11):
        self.ready = bool(len(good)) and 0 < good.sum() < len(good)
        if not self.ready:
            return
        self.middle, self.scale = np.median(x[good], 0), x[good].std(0) + 1e-3
        z = self.shrunk(x[good])
        self.low, self.high = np.quantile(z, [TAIL, 1 - TAIL], axis=0)
        v, rng = self.off(x), np.random.default_rng(seed)
        self.trees = [self.grow(v[rng.choice(len(v), min(TREE_ROWS, len(v)), replace=False)], rng) for _ in range(TREES)]
        self.norm = path_left(min(TREE_ROWS, len(v))) or 1.0

    def shrunk(self, x: np.ndarray) -> np.ndarray:
        n = np.expm1(x[:, 0])
        return (x - self.middle)[:, 1:] * (n / (n + HALF))[:, None] / self.scale[1:]

    def off(self, x: np.ndarray) -> np.ndarray:
        """How far each statistic is outside its range."""
        z = self.shrunk(x)
        return np.log1p(np.maximum(0, np.maximum(self.low - z, z - self.high)))

    def grow(self, v: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        """A tree as arrays: column (-1 at a leaf), cut, left, right, path length at a leaf."""
        column, cut, left, right, path = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(column)
            for a, x in ((column, -1), (cut, 0.0), (left, at), (right, at), (path, depth + path_left(len(rows)))):
                a.append(x)
            low, high = rows.min(0), rows.max(0)
            open_ = np.flatnonzero(high > low)
            if depth < DEPTH and len(open_):
                c = int(rng.choice(open_))
                column[at], cut[at] = c, rng.uniform(low[c], high[c])
                side = rows[:, c] <= cut[at]
                left[at], right[at] = node(rows[side], depth + 1), node(rows[~side], depth + 1)
            return at

        node(v, 0)
        return tuple(map(np.array, (column, cut, left, right, path)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; higher: isolated by fewer splits."""
        if not self.ready or not len(x):
            return np.zeros(len(x))
        v, total, rows = self.off(x), np.zeros(len(x)), np.arange(len(x))
        for column, cut, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                c = column[at]
                at = np.where(c < 0, at, np.where(v[rows, np.maximum(c, 0)] <= cut[at], left[at], right[at]))
            total += path[at]
        return 2 ** (-total / len(self.trees) / self.norm)


def calibrate(counts: list[tuple[int, bool, int]], loss: float = LOSS) -> float:
    """The bin above which rows are rejected: poor rows caught less ``loss`` times good rows lost, as shares."""
    good, poor = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for at, is_good, n in counts:
        (good if is_good else poor)[at] += n
    if not good.sum() or not poor.sum():
        return 2.0
    gain = (poor[::-1].cumsum()[::-1] / poor.sum() - loss * good[::-1].cumsum()[::-1] / good.sum())[1:]  # of rejecting bins from i + 1 on
    best = int(np.argmax(gain))
    return (best + 1) / BINS if gain[best] > 0 else 2.0


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: the base statistics, base_failed, anomaly (0 to 1) and kept."""
    stats = settle(statistics(docs, id_col, text_col), "rules")
    y = one_label(labels, None, id_col, label_col)
    rows = labelled(stats.select(F.col("doc_id").alias("_id"), F.col("x").alias("_x")), y)
    forest = docs.sparkSession.sparkContext.broadcast(Forest(*gathered(rows, sample)))
    names = [c for c in stats.columns if c != "x"]

    def run(batches):
        for b in batches:
            v = np.frombuffer(b"".join(b.column(b.schema.get_field_index("x")).to_pylist()), np.float32).reshape(-1, len(FEATURES)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(forest.value.score(v))], [*names, "anomaly"])

    scored = stats.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", anomaly double")
    bins = scored.join(y, F.col("doc_id") == F.col("_id")).groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), (F.col("_y") > 0.5).alias("good")).count().collect()  # 2 * BINS rows at most
    threshold = calibrate([tuple(r) for r in bins])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") < F.lit(threshold)))
