"""Quality scores by Bradley-Terry ranking: document scores from preference pairs, cut at a score quantile.

A good document is preferred to a poor one. Weights come from the logistic loss on feature differences of such pairs,
over a bounded sample of labelled documents (``SAMPLE``). Scores are then shifted so that the quantile at the share of
poor documents falls on 0.5; that quantile is taken over all usable labelled documents, by a histogram of their scores.
Every whole text is read where it lies, without a shuffle; only features travel to their labels.

Defined cases: a null text is empty; a text without words has all features zero and a score like any other; null
labels are left out, repeated labels of a document count once by their mean, and ties (mean one half) are left out; of
rows with equal ids the one with the least features counts in learning, and all are scored; without labels of both
kinds every score is 0.5 (and kept); an empty table gives an empty result; other columns stay as they are, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, settle
from .textstats import FEATURES, features

#: Labelled documents that training may gather at most (about 100 bytes each), pairs it draws of them, weight of the penalty.
SAMPLE, PAIRS, PENALTY = 20_000, 40_000, 1e-3
#: Bins of the histogram that places the threshold.
BINS = 20_000


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """Rows picked by their key's hash so that about ``most`` remain; the same rows each time."""
    share = min(1.0, most / max(1, rows.count()))
    mask = (1 << 30) - 1
    return rows.where(F.xxhash64(key).bitwiseAND(F.lit(mask)) <= F.lit(int(share * mask)))


def one_label(labels: DataFrame, usable: Column | None, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """_id, _y: the mean label of each document that has one other than one half."""
    y = labels.where(usable) if usable is not None else labels
    return y.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.avg(label_col).alias("_y")).where("_y <> 0.5")


def labelled(known: DataFrame, y: DataFrame) -> DataFrame:
    """_id, _y, _x: the features of each labelled document in ``known`` (_id, _x), one row per document, however many it has."""
    return settle(known.where("_id is not null").join(y, "_id").groupBy("_id").agg(F.min("_x").alias("_x"), F.first("_y").alias("_y")), "labelled")


def gathered(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about ``most`` of the documents of ``labelled`` at most, picked by hash."""
    got = sorted((r["_id"], bytes(r["_x"]), r["_y"]) for r in bounded(rows, "_id", most).collect())
    x = np.frombuffer(b"".join(r[1] for r in got), np.float32).reshape(-1, len(FEATURES)).astype(np.float64)
    return x, np.array([r[2] > 0.5 for r in got], bool)


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, len(FEATURES)).astype(np.float64)


def featured(rows: DataFrame, columns: list[str], into: str) -> DataFrame:
    """``columns`` of ``rows`` and the features of its last column, a text, as 32-bit floats."""

    def run(batches):
        for b in batches:
            x = [features(t).tobytes() for t in b.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(x, pa.binary())], [*columns, into])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}`{into}` binary")


class Ranker:
    """score(x) = sigmoid(w . f(x) - threshold), f being clipped standard scores and their sizes."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, penalty: float = PENALTY, seed: int = 7):
        self.ready = bool(len(good)) and 0 < good.sum() < len(good)
        if not self.ready:
            return
        self.mean, self.scale = x[good].mean(0), x[good].std(0) + 1e-3
        f, rng = self.expand(x), np.random.default_rng(seed)
        d = f[rng.choice(np.flatnonzero(good), pairs)] - f[rng.choice(np.flatnonzero(~good), pairs)]
        w = np.zeros(f.shape[1])
        for _ in range(25):  # Newton steps on the mean of log(1 + exp(-w . d))
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            gradient = -(d * p[:, None]).mean(0) + penalty * w
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + penalty * np.eye(len(w)), gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        self.place(f @ w, int((~good).sum()))

    def place(self, scores: np.ndarray, poor: int) -> None:
        """Put the threshold on the quantile at the share of poor documents."""
        s = np.sort(scores)
        self.threshold = (s[max(poor - 1, 0)] + s[min(poor, len(s) - 1)]) / 2

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.abs(z)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.w - self.threshold, -30, 30)))


def fitted(known: DataFrame, y: DataFrame, sample: int) -> Ranker:
    """A ranker learned from a sample of the labelled documents, its threshold placed over all of them."""
    rows = labelled(known, y)
    model = Ranker(*gathered(rows, sample))
    if not model.ready:
        return model
    shared = known.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            at = (shared.value.score(unpacked(b.column(0))) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(1)], ["bin", "y"])

    counts = rows.select("_x", "_y").mapInArrow(run, "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") < 0.5).cast("long")).alias("poor")).collect()  # one row per bin
    counts.sort()
    below = np.cumsum([r["n"] for r in counts])
    at = counts[min(int(np.searchsorted(below, sum(r["poor"] for r in counts))), len(counts) - 1)]["bin"]
    cut = np.clip((at + 1) / BINS, 1e-6, 1 - 1e-6)
    model.threshold += np.log(cut / (1 - cut))
    return model


def rank_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``columns`` of ``docs`` (all, if not given) with a score and a prediction (1: kept) added as ``into``, in place of
    columns of these names. With ``columns`` given, features are computed once and settled with them."""
    y = one_label(labels, usable, id_col)
    names = [c for c in (docs.columns if columns is None else columns) if c not in into]
    if columns is None:
        known = settle(featured(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), ["_id"], "_x"), "features")
        plain = docs.select(*names, F.col(text_col).alias(*fresh(docs, "_text")))
    else:
        (key, x) = fresh(docs, "_id", "_x")
        plain = settle(featured(docs.select(*names, F.col(id_col).alias(key), F.col(text_col).alias(x)), [*names, key], x), "features")
        known = plain.select(F.col(key).alias("_id"), F.col(x).alias("_x"))
        plain = plain.drop(key)
    model = docs.sparkSession.sparkContext.broadcast(fitted(known, y, sample))

    def run(batches):
        for b in batches:
            last = b.column(len(names))
            if columns is None:
                last = pa.array([features(t).tobytes() for t in last.to_pylist()], pa.binary())
            s = model.value.score(unpacked(last))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*names, *into])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields[:-1])
    return plain.mapInArrow(run, f"{fields}`{into[0]}` double, `{into[1]}` int")


def held_out(id_col: str = "doc_id") -> Column:
    """The third of the rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
