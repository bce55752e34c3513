"""How rows lie before work that is done row by row, and how much of a batch that work holds at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Partitions that a small scan is dealt over at most.
MOST = 64
#: Bytes of text, and rows, that a kernel takes at once.
SLICE_BYTES, SLICE_ROWS = 1 << 21, 1000


def spread(scan: DataFrame) -> DataFrame:
    """A scan whose rows lie in fewer partitions than there are cores (and than ``MOST``), dealt out over as many; any other
    one as it is.

    A row group cannot be split: where files are cut at more places than they have row groups, some partitions hold no row.
    So rows are counted by partition (footers alone are read), and a scan is dealt out where the fullest one has more than
    twice its share. What this shuffles is less than ``MOST`` splits of a scan (8 GB at Spark's default split size), however
    many cores there are, or a scan that would leave cores idle.
    """
    want = min(scan.sparkSession.sparkContext.defaultParallelism, MOST)
    parts = scan.rdd.getNumPartitions()
    if parts >= want:
        per = scan.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
        rows, fullest = per.agg(F.sum("n"), F.max("n")).first()
        if not rows or fullest * want <= 2 * rows:
            return scan
    return scan.repartition(max(want, parts))


def slices(texts: pa.Array, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[pa.Array]:
    """Runs of a batch, each of ``most_bytes`` and ``most_rows`` at most (a longer text stands alone)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        until = int(np.searchsorted(ends, before + most_bytes, side="right"))
        until = min(max(until, at + 1), at + most_rows, len(texts))
        yield texts.slice(at, until - at)
        at = until


def by_slices(kernel: Callable[[str | None], object], kind: T.DataType) -> Callable[[Column], Column]:
    """``kernel`` over a column of texts. Texts and results are held as Python's objects for one slice of a batch at a time."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for s in slices(b):
                yield pa.array([kernel(t) for t in s.to_pylist()], arrow)

    return run
