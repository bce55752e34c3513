"""Token ids as flat unsigned integer files with 64-bit document offsets, read back through memory maps.

Format, one set of files per part (parts are ranges of doc_id, in order): ``part-N.ids`` holds the ids of its documents
one after the other, unsigned, little-endian, 16 bits wide if all ids of the vocabulary and the end id fit, else 32; ``part-N.off`` holds
k + 1 unsigned 64-bit positions, the i-th document being ids[off[i]:off[i+1]]; ``part-N.doc`` holds the k doc_ids. The
manifest (one row per part) gives the width and each part's base, the number of ids before it: a prefix sum over parts. A task
writes under names of its own and renames whole files, so lost executors and repeated attempts do no harm.

Defined cases: a null text is empty (its end id alone); an empty table gives no part; repeated rows are written once
each, next to each other; a null doc_id sorts first and is stored as the smallest long; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, new_path
from .tokens import read_spec, tokenizer

NULL_ID = -(1 << 63)


def largest_id(spec: str) -> int:
    """The largest id that a vocabulary file can give."""
    spec = json.loads(spec)
    vocab = spec["model"]["vocab"]
    return max([*(vocab.values() if isinstance(vocab, dict) else [len(vocab) - 1]), *(x["id"] for x in spec.get("added_tokens", []))], default=0)


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int, int, int, int]]:
    """Write the files; returns the manifest in order: (part, name, documents, ids, base, bytes of an id). One entry per part."""
    spark = docs.sparkSession
    path, content = path or new_path(spark, "tokens"), read_spec(vocabulary)
    spec, width = spark.sparkContext.broadcast(content), 2 if max(end_id, largest_id(content)) < 1 << 16 else 4

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        part, mine = context.partitionId(), f"{context.taskAttemptId()}-{os.getpid()}"
        t, store, offsets, ids_of, n = tokenizer(spec.value), Store(path), [np.zeros(1, np.int64)], [], 0
        name, temp = f"part-{part:06d}", f"_part-{part:06d}-{mine}"
        out = None
        for b in batches:
            ids_of += [NULL_ID if d is None else d for d in b.column(0).to_pylist()]
            for ids, ends in t.slices(b.column(1), end_id):
                out = out or store.writer(f"{temp}.ids")
                out.write(ids.astype("<u2" if width == 2 else "<u4").tobytes())
                offsets.append(ends[1:] + n)
                n += len(ids)
        if out is None:
            return
        out.close()
        for kind, values in (("off", np.concatenate(offsets).astype("<u8")), ("doc", np.array(ids_of, "<i8"))):
            with store.writer(f"{temp}.{kind}") as f:
                f.write(values.tobytes())
        for kind in ("ids", "off", "doc"):
            store.publish(f"{temp}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "name": [name], "documents": pa.array([len(ids_of)], pa.int64()), "ids": pa.array([n], pa.int64())})

    key = F.col(id_col).cast("long")
    ordered = docs.select(key.alias("d"), F.col(text_col).alias("t")).repartitionByRange("d", F.xxhash64("t")).sortWithinPartitions("d", "t")
    rows = sorted(ordered.mapInArrow(run, "part long, name string, documents long, ids long").collect())  # one row per part
    manifest, base = [], 0
    for part, name, documents, ids in rows:
        manifest.append((part, name, documents, ids, base, width))
        base += ids
    return manifest


def read_tokens(spark: SparkSession, path: str, manifest: list[tuple[int, str, int, int, int, int]], with_ids: bool = False) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 [, ids as little-endian unsigned 32-bit bytes]."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if not manifest:
        return spark.createDataFrame([], schema)

    def run(batches):
        store = Store(path)
        for b in batches:
            for name, base, width in zip(*(c.to_pylist() for c in b.columns)):
                ids = store.array(f"{name}.ids", "<u2" if width == 2 else "<u4")
                off, doc = store.array(f"{name}.off", "<u8").astype(np.int64), store.array(f"{name}.doc", "<i8")
                for lo in range(0, len(doc), 1000):
                    hi = min(lo + 1000, len(doc))
                    raw, at = memoryview(ids[off[lo] : off[hi]].astype("<u4").tobytes()), ((off[lo : hi + 1] - off[lo]) * 4).tolist()
                    blobs = [raw[x:y] for x, y in zip(at, at[1:])]
                    keys = [None if d == NULL_ID else int(d) for d in doc[lo:hi]]
                    arrays = [pa.array(keys, pa.int64()), pa.array(base + off[lo:hi]), pa.array(np.diff(off[lo : hi + 1])), pa.array(map(zlib.crc32, blobs), pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays + [pa.array(map(bytes, blobs), pa.binary())] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    parts = spark.createDataFrame([(m[1], m[4], m[5]) for m in manifest], "name string, base long, width int").repartition(len(manifest))
    return parts.mapInArrow(run, schema)
