"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Where the setting is absent and the session runs in one process (tests, benches), a temporary folder is made and
    noted in the session. On a cluster an absent setting is an error: no machine-local folder is ever used there.
    """
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", at)
    if "://" not in at and not at.startswith("file:"):
        at = "file://" + os.path.abspath(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/brindle/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made longer until no column of ``df`` has it (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def ascii_lower(col):
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def once(value, f):
    """``f`` of a column's value that is computed once, however often ``f`` uses it (in its own lambdas too)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def local_path(uri: str) -> str | None:
    """The path in a mounted file system, or None where the folder is in another store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


class Store:
    """Byte files in the shared folder: a mounted path is used as it is, any other scheme through Arrow's file systems."""

    def __init__(self, uri: str):
        self.local = local_path(uri)
        if self.local is None:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(uri)
        else:
            os.makedirs(self.local, exist_ok=True)

    def writer(self, name: str):
        """A file under a name of its own, so that attempts of one task never share a file."""
        if self.local is not None:
            return open(f"{self.local}/{name}", "wb", buffering=1 << 20)
        return self.fs.open_output_stream(f"{self.base}/{name}")

    def publish(self, temp: str, name: str) -> None:
        """Give a whole file its final name; a repeated attempt replaces equal bytes."""
        if self.local is not None:
            os.replace(f"{self.local}/{temp}", f"{self.local}/{name}")
        else:
            self.fs.move(f"{self.base}/{temp}", f"{self.base}/{name}")

    def reader(self, name: str):
        if self.local is not None:
            return open(f"{self.local}/{name}", "rb", buffering=1 << 20)
        return self.fs.open_input_stream(f"{self.base}/{name}")

    def array(self, name: str, dtype):
        """The file as an array: memory-mapped where the store is mounted."""
        import numpy as np

        if self.local is not None:
            path = f"{self.local}/{name}"
            return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
        return np.frombuffer(self.fs.open_input_file(f"{self.base}/{name}").read(), dtype)
