"""What ingestion adds to chunks: a source label, the page they start on, metadata."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import strip

PAGE = re.compile(r"(?m)^#+\s*Sayfa\s+(\d+)\s*$")


@F.pandas_udf(T.StringType())
def doc_label(names: pd.Series) -> pd.Series:
    """The file's name as a title, without its suffix."""
    return names.map(lambda x: None if x is None else x.rsplit(".", 1)[0].replace("-", " ").replace("_", " ").title())


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("page", T.IntegerType())])))
def page_marks(texts: pd.Series) -> pd.Series:
    """Places (in characters, from 0) of the page headings and their numbers."""
    return texts.map(lambda t: [{"pos": m.start(), "page": int(m[1])} for m in PAGE.finditer(t or "")])


def place_of(text: Column, content: Column) -> Column:
    """Where the content's first 200 characters stand in the text, or else its first 80 (from 0; null if nowhere)."""
    long, short = strip(F.substring(content, 1, 200)), strip(F.substring(content, 1, 80))
    at = F.coalesce(F.nullif(F.position(long, text), F.lit(0)), F.nullif(F.position(short, text), F.lit(0)))
    return F.when(long != "", at - 1)


def page_at(marks: Column, place: Column) -> Column:
    """As-of: the number of the last page heading at or before the place."""
    return F.try_element_at(F.filter(marks, lambda m: m["pos"] <= place), F.lit(-1))["page"]


def page_as_of(chunks: DataFrame, marks: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """The same as a relation: each chunk row with the page of the last mark (keys, pos, page) at or before it. Marks are
    gathered per document and looked up within the row, so there is no row per (chunk, mark)."""
    per = marks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "page"))).alias("_marks"))
    return chunks.join(per, keys, "left").withColumn("page", page_at(F.col("_marks"), F.col(place))).drop("_marks")


def page_of(text: str, marks: list[tuple[int, int]], content: str) -> int | None:
    """The plain twin: the page (marks: place, number) that the content's head stands on, in ``text``."""
    for n in (200, 80) if marks else ():
        head = content[:n].strip()
        if head and (at := text.find(head)) >= 0:
            i = bisect_right(marks, at, key=lambda m: m[0])
            return marks[i - 1][1] if i else None
    return None


def prefixed(label: Column, kind: Column, header: Column, content: Column) -> Column:
    """The text that is embedded: source and kind, section if any, content."""
    section = F.when(F.coalesce(header, F.lit("")) != "", F.concat(F.lit("\n[Bölüm: "), header, F.lit("]"))).otherwise(F.lit(""))
    return F.concat(F.lit("[Kaynak: "), label, F.lit(" | Doküman Türü: "), kind, F.lit("]"), section, F.lit("\n\n"), content)


def metadata(filename: Column, content: Column, original_length: Column, header: Column, position: Column, kind: Column, dictionary: Column, page: Column) -> Column:
    """A chunk's JSON: a null header stays, a null page does not."""
    keys = [F.regexp_extract(filename, r"(\.[^.]*)$", 1).alias("file_type"), F.length(content).alias("chunk_size"), original_length.alias("original_length"), header.alias("header"), filename.alias("source"), position.alias("chunk_position"), kind.alias("doc_type"), dictionary.alias("is_dictionary")]
    options = {"ignoreNullFields": "false"}
    return F.when(page.isNull(), F.to_json(F.struct(*keys), options)).otherwise(F.to_json(F.struct(*keys, page.cast("string").alias("source_page")), options))
