"""Token ids by the ``tokenizers`` library's files, from the distinct words of a slice of texts.

Both kinds of files split a text at white space before any merge, so the ids of a text are the ids of its words in a
row. Arrow cuts a slice of texts into words and numbers the distinct ones. When the file is of a known shape (its merges
are in the order of its ids), all distinct words are merged in one call of ``tiktoken``, and token lengths in bytes tell
where each word ends; the ids of the slice are one gather. Other words, and files of other shapes, go to ``tokenizers``
itself; so do whole texts in which a cut at a space could change the outcome (runs of white space, special tokens' names).
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut at once (one text at least). Only speed and memory depend on it.
SLICE = 12 << 20

#: A white space character before a space; words that are lower-cased and cut alike by any library (no white space, no
#: marks to compose); the pieces of such a word, as the files of word ends cut it.
_RUN = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_PLAIN = r"^[\x21-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]+$"
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[\d\xb2\xb3\xb9\xbc-\xbe]|(?:[^\s\w]|_)+")

_loaded: dict[int, "WordTokenizer"] = {}


def _byte_of() -> dict[str, int]:
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(spec)
        self.kind, self.merge = "full", None
        self.specials = [x["content"][:2] for x in json.loads(spec).get("added_tokens", [])]
        self._ranks(json.loads(spec))

    def _ranks(self, spec: dict) -> None:
        model = spec["model"]
        if model.get("type") != "BPE" or model.get("unk_token") not in (None, "<|endoftext|>") or model.get("dropout"):
            return
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        if any(b <= a for a, b in zip(made, made[1:])) or model.get("continuing_subword_prefix"):
            return
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])] or [(spec["normalizer"] or {}).get("type")]
        pre = spec["pre_tokenizer"] or {}
        parts = [x["type"] for x in pre.get("pretokenizers", [])] or [pre.get("type")]
        byte_of, special = _byte_of(), {x["content"] for x in spec.get("added_tokens", [])}
        ranks: dict[bytes, int] = {}
        for word, i in vocab.items():
            if word in special:
                continue
            ended = bool(suffix) and word.endswith(suffix)
            body = word[: -len(suffix)] if ended else word
            if any(c not in byte_of for c in body):
                return
            ranks[bytes(byte_of[c] for c in body) + b"\xff" * ended] = i
        if any(bytes([b]) not in ranks for b in range(256)):
            return
        import tiktoken

        if suffix and normal == ["NFC", "Replace", "Lowercase"] and parts == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"].get("Regex", "").replace("[\\p{L}]", "\\p{L}").replace("[\\p{N}]", "\\p{N}") == _PIECE:
            import regex

            self.kind, self.split = "ended", regex.compile(_PIECE)
            marked = {w[:-1] + b"\0" if w[-1:] == b"\xff" and len(w) > 1 else w: i for w, i in ranks.items()}
            self.ended = tiktoken.Encoding("ended", pat_str=r"[^\x00\s]+\x00", mergeable_ranks=marked, special_tokens={})
        elif not suffix and normal == [None] and parts == ["ByteLevel"] and not pre.get("add_prefix_space") and pre.get("use_regex", True):
            self.kind = "bytes"
        else:
            return
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of[list(ranks.values())] = [len(w) for w in ranks]
        self.merge = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _new(self, word: str) -> list[int]:
        if self.kind == "bytes":
            return self.merge.encode_ordinary(word)
        if self.kind == "ended" and (word.isascii() or max(word) < "ɐ") and "İ" not in word:
            piece, out = self.merge._core_bpe.encode_single_piece, []
            for x in self.split.findall(unicodedata.normalize("NFC", word).lower()):
                out += piece(x.encode() + b"\xff")
            return out
        return self.full.encode(word, add_special_tokens=False).ids

    def ids(self, text: str | None, end: int | None = None) -> np.ndarray:
        """Unsigned 32-bit ids of a whole text (null counts as empty), then ``end``."""
        out = self.many(pa.array([text or ""], pa.large_string()), 0 if end is None else end)[0]
        return out[:-1] if end is None else out

    def slices(self, texts: pa.Array, end: int):
        """For slices of the texts (nulls count as empty), in order: the ids of all, ``end`` after each text's, and the
        positions between texts (0 first)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)])
        lo, n = 0, len(texts)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + SLICE, "right")) - 1)
            yield self.many(texts.slice(lo, hi - lo), end)
            lo = hi

    def many(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end`` after each one's, and the positions between texts."""
        odd = np.full(len(texts), self.kind == "full")
        if self.kind == "bytes":
            odd |= pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
        for x in set(self.specials):
            odd |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.even(texts, end)
        even = texts.filter(pa.array(~odd))
        ids, ends = self.even(even, end) if len(even) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        parts, k = [], 0
        for text, whole in zip(texts.to_pylist(), odd.tolist()):
            parts.append(np.array([*self.full.encode(text, add_special_tokens=False).ids, end], np.uint32) if whole else ids[ends[k] : ends[k + 1]])
            k += not whole
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def even(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """``many`` of texts that may be cut at spaces."""
        if self.kind == "ended":
            for x in "\n\t\r":
                texts = pc.replace_substring(texts, x, " ")
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        flat, first, count = self.distinct(coded.dictionary)
        code = coded.indices.to_numpy()
        begin, size = first[code], count[code]
        if self.kind == "bytes":  # a text's first word has no space before it
            heads = pc.list_element(cut, 0).dictionary_encode()
            ids = [self._new(x) for x in heads.dictionary.to_pylist()]
            n, code = np.array([len(x) for x in ids], np.int64), heads.indices.to_numpy()
            begin[offsets[:-1] - offsets[0]], size[offsets[:-1] - offsets[0]] = (len(flat) + np.cumsum(n) - n)[code], n[code]
            flat = np.concatenate([flat, np.array([i for x in ids for i in x], np.uint32)])
        stops = np.cumsum(size)
        where = np.arange(stops[-1])
        where += np.repeat(begin - (stops - size), size)
        ends = np.concatenate([[0], stops])[offsets - offsets[0]]
        return np.insert(flat[where], ends[1:], np.uint32(end)), ends + np.arange(len(ends))

    def distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's ids begin, how many it has). All words are merged in one call; a word whose bounds are
        not bounds of tokens is merged on its own."""
        if self.kind == "bytes":
            text = joined(pc.binary_join_element_wise(pa.scalar("", words.type), words, pa.scalar(" ", words.type))).decode()
            ids, size = self.merge.encode_to_numpy(text, disallowed_special=()), pc.binary_length(words).to_numpy() + 1
            alone = np.zeros(len(words), bool)
        else:
            plain = pc.match_substring_regex(words, _PLAIN)
            lines = joined(pc.binary_join_element_wise(pc.utf8_lower(pc.if_else(plain, words, "")), pa.scalar("", words.type), pa.scalar("\n", words.type)))
            text = _PIECES.sub("\\g<0>\0", lines.decode())
            ids = self.ended.encode_to_numpy(text, disallowed_special=())
            size = np.diff(np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 10), prepend=-1) - 1
            alone = ~plain.to_numpy(zero_copy_only=False)
        ends, stops = np.concatenate([[0], np.cumsum(self.bytes_of[ids])]), np.cumsum(size, dtype=np.int64)
        at = np.searchsorted(ends, stops, side="right") - 1
        first, wrong = np.concatenate([[0], at[:-1]]), ends[at] != stops
        count = at - first
        alone |= wrong | np.concatenate([[False], wrong[:-1]])
        if alone.any():
            own = [self._new(f" {w}" if self.kind == "bytes" else w) for w in words.filter(pa.array(alone)).to_pylist()]
            n = np.array([len(x) for x in own], np.int64)
            first[alone], count[alone] = len(ids) + np.cumsum(n) - n, n
            ids = np.concatenate([ids, np.array([i for x in own for i in x], np.uint32)])
        return ids, first, count


def joined(words: pa.Array) -> bytes:
    """The strings' bytes one after the other."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return words.buffers()[2].to_pybytes()[at[0] : at[-1]] if len(words) and words.buffers()[2] else b""


def tokenizer(spec: str) -> WordTokenizer:
    """The tokenizer of a file's content; a worker builds it once."""
    key = hash(spec)
    if key not in _loaded:
        _loaded[key] = WordTokenizer(spec)
    return _loaded[key]


def read_spec(path: str) -> str:
    """The vocabulary file's content, read on the driver; it is some MB, whatever the input's size."""
    with open(path, encoding="utf-8") as f:
        return f.read()
