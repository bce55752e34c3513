"""Scanned documents: pages become images, a vision model reads each one, and pages are assembled by document.

Both steps are boundaries: ``render`` makes page images of a PDF, ``read_page`` makes markdown of an image. A page that
cannot be read is recorded and harms no other.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import strip_markup

PAGE_IMAGES = "filename string, page int, image binary"
PAGES = "filename string, page int, status string, char_count int, error string, markdown string"


def image_folder(spark: SparkSession, path: str) -> DataFrame:
    """filename, page, image of a folder of page images (``Page*.png``, or else ``page_*.png``), numbered in the order of
    the digits in their names."""
    for glob in ("Page*.png", "page_*.png"):
        df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
        if df.limit(1).count():
            break
    name = F.element_at(F.split("path", "/"), -1)
    digits = F.coalesce(F.try_to_number(F.nullif(F.regexp_replace(name, r"\D", ""), F.lit("")), F.lit("9999999999")), F.lit(0)).cast("int")
    return df.select(name.alias("filename"), digits.alias("page"), F.col("content").alias("image"))


def render_pages(files: DataFrame, render: Callable[[bytes, int], list[bytes]], dpi: int = 150) -> DataFrame:
    """filename, page (from 1), image of PDF files (filename, content), one page at a time."""

    def run(parts):
        for pdf in parts:
            for name, content in zip(pdf["filename"], pdf["content"]):
                images = render(bytes(content), dpi)
                yield pd.DataFrame({"filename": [name] * len(images), "page": range(1, len(images) + 1), "image": images})

    return files.select("filename", "content").mapInPandas(run, PAGE_IMAGES)


def read_pages(images: DataFrame, read_page: Callable[[bytes, int], str]) -> DataFrame:
    """One row per page image: its markdown, or the error that reading it gave."""

    def run(parts):
        for pdf in parts:
            rows = []
            for name, page, image in zip(pdf["filename"], pdf["page"], pdf["image"]):
                try:
                    rows.append((name, page, "ok", 0, None, read_page(bytes(image), int(page))))
                except Exception as e:
                    rows.append((name, page, "error", None, str(e), None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PAGES.split(", ")])

    read = images.mapInPandas(run, PAGES)
    clean = strip_markup(F.col("markdown"))
    return read.withColumn("markdown", clean).withColumn("char_count", F.length("markdown"))


def assemble(pages: DataFrame) -> DataFrame:
    """filename, markdown, n_pages, n_errors, errors: the readable pages of each document in order, below page marks."""
    part = F.when(F.col("status") == "ok", F.concat(F.lit("\n---\n## Sayfa "), F.col("page").cast("string"), F.lit("\n\n"), F.col("markdown")))
    fault = F.when(F.col("status") != "ok", F.concat(F.lit("Sayfa "), F.col("page").cast("string"), F.lit(" hata: "), F.coalesce("error", F.lit(""))))
    per = pages.groupBy("filename").agg(F.count(F.lit(1)).alias("n_pages"), F.array_sort(F.collect_list(F.struct("page", part.alias("part"), fault.alias("fault")))).alias("x"))
    parts, errors = F.array_compact(F.transform("x", lambda p: p["part"])), F.array_compact(F.transform("x", lambda p: p["fault"]))
    head = F.concat(F.lit("# İstihbarat Raporu — "), "filename", F.lit("\n\nSayfa sayısı: "), F.col("n_pages").cast("string"), F.lit("\n"))
    return per.select("filename", F.array_join(F.concat(F.array(head), parts), "\n").alias("markdown"), "n_pages", F.size(errors).cast("long").alias("n_errors"), errors.alias("errors"))
