"""Whole-text statistics that the quality operators build on: one pass of byte-level work per text."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np

#: Function words of the languages at hand; their share tells prose from lists and noise.
STOP_WORDS = frozenset(
    """the of and to in is that for it was on with as be at by from or an this are not
    le la les de des du et un une en dans que qui pour est sur par au avec il elle
    der die das und in zu den von mit sich des auf ist ein eine im dem nicht als
    el la los las de y en que un una por con no es su del lo""".encode().split()
)
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b".,", b"!?", SYMBOLS, b";:'\"()-", b"_=+/\\[]{}@^~`"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:192] = 10  # later bytes of a character
_CLASS[192:] = 11

FEATURES = (
    "log_words", "word_length", "word_spread", "longest_word", "upper", "digits", "stops_commas", "marks", "symbols", "quotes", "others", "non_ascii",
    "distinct", "adjacent", "repeated", "dup_lines", "line_words", "capital_words", "upper_words", "stop_words", "top_word",
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included. Hashes find, bytes confirm."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(window):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    seen = Counter(tuple(words[i : i + window]) for i in at.tolist())
    covered = np.zeros(len(words) + 1, np.int64)
    for i in at.tolist():
        if seen[tuple(words[i : i + window])] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered) > 0).sum())


def base_rules(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, as the quality rules define them."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    space = sum(map(raw.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - space, sum(raw.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def features(text: str | None, repeats: int | None = None) -> np.ndarray:
    """``FEATURES`` of a text; zeros for a text without words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES), np.float32)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=12)
    letters = max(1, kinds[1] + kinds[2] + kinds[11])
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    stop = sum(c for w, c in counts.items() if w.lower().strip(b".,;:!?") in STOP_WORDS)
    shout = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    capital = sum(c for w, c in counts.items() if w[:1].isupper())
    repeats = repeated_words(words) if repeats is None else repeats
    return np.array(
        [
            np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()), kinds[1] / letters, kinds[3] / letters, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[8] / n, (kinds[9] + kinds[0]) / n, kinds[11] / letters,
            len(counts) / n, sum(map(eq, words, words[1:])) / n, repeats / n, 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), capital / n, shout / n, stop / n, max(counts.values()) / n,
        ],
        np.float32,
    )
