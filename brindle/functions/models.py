"""Boundaries to models: any function over a column of texts; deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def embedder(model: Callable[[list[str]], list[list[float]]], batch: int = 128) -> Callable[[Column], Column]:
    """A column function around ``model``, which gets at most ``batch`` texts at a time and returns as many vectors."""

    @F.arrow_udf("array<float>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in parts:
            for i in range(0, len(s), batch):
                texts = [t or "" for t in s.slice(i, batch).to_pylist()]
                got = model(texts)
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                yield pa.array(got, pa.list_(pa.float32()))

    return run


def hash_vectors(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Signed feature hashing of words, with unit length: equal texts, equal vectors."""
    out = []
    for t in texts:
        v = np.zeros(dim)
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32).tolist())
    return out


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """How often each small letter stands in a text: vectors that any language can check."""
    return [[float(t.count(c)) for c in LETTERS] for t in texts]


def first_sentence(system: Column, prompt: Column) -> Column:
    """A stand-in for a language model: the first sentence of the first source."""
    body = F.regexp_extract(prompt, r"(?s)\]\n(.*?)(?:[.!?](?:\s|$)|\n\n---|\n\nSORU)", 1)
    return F.when(body == "", F.lit("?")).otherwise(F.concat(body, F.lit(".")))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def stream_tokens(lines: Column) -> Column:
    """The text deltas of a streamed completion's lines, up to its end mark; unreadable lines are passed over."""
    body = F.transform(F.filter(lines, lambda x: x.startswith("data: ")), lambda x: F.trim(F.substring(x, 7, 1 << 30)))
    stop = F.array_position(body, F.lit("[DONE]"))
    upto = F.when(stop > 0, F.slice(body, 1, (stop - 1).cast("int"))).otherwise(body)
    return F.filter(F.transform(upto, lambda x: F.get_json_object(x, "$.choices[0].delta.content")), lambda x: x.isNotNull() & (x != ""))
