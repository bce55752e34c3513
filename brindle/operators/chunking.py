"""Chunking: paragraph packing, sliding windows and line groups as native expressions; headings and records by a kernel.

The kernels are plain functions of one text; ``chunks_of`` runs the router in an Arrow-batched function and explodes its
array, so documents never meet and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.normalize import strip
from .layout import by_slices

SIZE, LEAST = 1000, 50
#: Records of a bank section and lines of the other sectioned kinds that make a chunk.
PER_CHUNK = {"records": 10, "seizures": 8, "limits": 12}
HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)
FIELDS = [T.StructField("content", T.StringType()), T.StructField("header", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("position", T.IntegerType())]
CHUNK = T.ArrayType(T.StructType(FIELDS))


def paragraphs(text: Column, size: int = SIZE) -> Column:
    """Whole paragraphs (by empty lines, else by lines) packed while the running length stays under ``size``."""
    by_gap = F.split(text, "\n\n")
    parts = F.when(F.size(by_gap) > 1, by_gap).otherwise(F.split(text, "\n"))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("open"))

    def step(s, p):
        fits = F.length(s["open"]) + F.length(p) < size
        closed = F.when(fits | (s["open"] == ""), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.struct(closed.alias("done"), F.when(fits, F.concat(s["open"], p, F.lit("\n\n"))).otherwise(F.concat(p, F.lit("\n\n"))).alias("open"))

    return F.aggregate(parts, start, step, lambda s: F.transform(F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))), strip))


def sliding(text: Column, size: int = SIZE, overlap: int = 200) -> Column:
    """Character windows that start every ``size - overlap`` characters."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def line_groups(text: Column, title: str, per_chunk: int, note: str = "") -> Column:
    """A section's data lines in groups, each below the section's title and note; the text itself if it has none."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: (strip(x) != "") & ~strip(x).startswith("#") & ~strip(x).startswith("Tüm tutarlar Bin TL"))
    head = f"## {title}\n\n" + (f"{note}\n\n" if note else "")

    def groups(found):
        starts = F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)), F.lit(per_chunk))
        return F.when(F.size(found) > 0, F.transform(starts, lambda i: F.concat(F.lit(head), F.array_join(F.slice(found, i + 1, per_chunk), "\n"))))

    # an array of the one list binds it: as an expression it would be cut and filtered anew for each group
    return F.coalesce(F.get(F.transform(F.array(lines), groups), F.lit(0)), F.array(text))


def pack_paragraphs(text: str, size: int = SIZE) -> list[str]:
    """The plain twin of ``paragraphs``."""
    parts = text.split("\n\n")
    out, held = [], ""
    for p in parts if len(parts) > 1 else text.split("\n"):
        if len(held) + len(p) >= size:
            out += [held] if held else []
            held = ""
        held += f"{p}\n\n"
    return [x.strip() for x in ([*out, held] if held else out)]


def sections(text: str, keep_preamble: bool = False) -> list[dict]:
    """A chunk per heading, named by the path of the headings above it. Text before the first one is left out."""
    found = list(HEADING.finditer(text))
    if not found:
        return [{"content": c, "header": None, "level": 0, "position": i} for i, c in enumerate(pack_paragraphs(text))]
    out, path = [], []
    if keep_preamble and text[: found[0].start()].strip():
        out.append({"content": text[: found[0].start()].strip(), "header": None, "level": 0, "position": -1})
    for i, m in enumerate(found):
        level, title = len(m[1]), m[2].strip()
        path = [x for x in path if x[0] < level] + [(level, title)]
        until = found[i + 1].start() if i + 1 < len(found) else len(text)
        out.append({"content": text[m.start() : until].strip(), "header": " > ".join(t for _, t in path), "level": level, "position": i})
    return out


def bank_records(text: str, per_chunk: int = PER_CHUNK["records"]) -> list[str]:
    """Records start at ``Banka:``; notes and indented lines continue them, any other line ends them."""
    records: list[list[str]] = []
    inside = False
    for line in text.splitlines():
        bare = line.strip()
        if bare.startswith("#"):
            continue
        if bare.startswith("Banka:"):
            records.append([line])
            inside = True
        elif inside and bare and (bare.startswith("Not:") or line.startswith("  ")):
            records[-1].append(line)
        else:
            inside = False
    blocks = ["\n".join(x for r in records[i : i + per_chunk] for x in r) for i in range(0, len(records), per_chunk)]
    return ["## Banka İstihbaratı\n\n" + b for b in blocks] or [text]


def grouped_lines(text: str, title: str, per_chunk: int, note: str = "") -> list[str]:
    """The plain twin of ``line_groups``."""
    lines = [x for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "Tüm tutarlar Bin TL"))]
    head = f"## {title}\n\n" + (f"{note}\n\n" if note else "")
    return [head + "\n".join(lines[i : i + per_chunk]) for i in range(0, len(lines), per_chunk)] or [text]


def _named(header: str, *names: str) -> bool:
    return any(n in header or n in header.lower() for n in names)


def route(text: str | None, size: int = SIZE, keep_preamble: bool = False) -> list[dict]:
    """The chunker: sections, each cut as its header asks; pieces under ``LEAST`` characters go."""
    out = []
    for c in sections(text or "", keep_preamble):
        header, content = c["header"] or "", c["content"]
        if len(content) < LEAST:
            continue
        if _named(header, "Banka İstihbaratı", "banka_istihbarati"):
            parts = bank_records(content)
        elif _named(header, "E-Haciz", "e_haciz"):
            parts = grouped_lines(content, "E-Haciz Tarihçesi", PER_CHUNK["seizures"])
        elif _named(header, "Limit Risk", "Kaynak Bazında", "limit_risk", "kaynak_bazinda"):
            title = "Limit Risk Bilgileri" if _named(header, "Limit Risk", "limit_risk") else "Kaynak Bazında Detay"
            parts = grouped_lines(content, f"{title} (Bin TL)", PER_CHUNK["limits"], "Tüm tutarlar Bin TL'dir.")
        elif len(content) > 1.2 * size:
            out += [c | {"content": p, "position": i} for i, p in enumerate(pack_paragraphs(content, size)) if len(p) >= LEAST]
            continue
        else:
            parts = [content]
        out += [c | {"content": p} for p in parts]
    return out


def chunker(kernel: Callable[[str], list[dict]] = route) -> Callable[[Column], Column]:
    return by_slices(lambda t: kernel(t or ""), CHUNK).asNondeterministic()  # else a filter on the array's size is put below the explode, and runs it twice


def chunks_of(docs: DataFrame, text: str = "text", kernel: Callable[[str], list[dict]] = route) -> DataFrame:
    """``docs`` without its text, one row per chunk: chunk_index (from 0), content, header, level, position."""
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(chunker(kernel)(F.col(text))).alias("chunk_index", "c")).select(*rest, "chunk_index", "c.*")
