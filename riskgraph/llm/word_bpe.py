"""BPE encoding and decoding over a contiguous rank array.

A word is a row of parts. Beside the parts stands an array with the merge rank of each adjacent pair. The smallest
rank is found by a scan, the boundary there is deleted, and the ranks of the two neighbours are refreshed, until no
pair has a rank. Words over LONG parts, where scans would cost the square of the length, use a heap of the same
ranks with a linked list; both give the leftmost smallest merge first.

Texts are prepared as the vocabulary file says: special strings are single ids; the rest is brought to NFC, white
space becomes one space, letters lower case, and the words are those of the file's pattern, as bytes. Decoding
joins the vocabulary's strings by single spaces, as the file names no decoder.

Cases: null and empty texts give no ids and an empty text; a null doc_id stays; repeated rows each get a row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .packing import default_tokenizer

LONG = 96
_LATER = re.compile("[\u0558-\U0010ffff]").search  # where a newer Unicode may know letters that unicodedata doesn't
_ID = (1 << 32) - 1
_NONE = 1 << 63


_OTHER = re.compile("[^\0-\u024f]|[\x1c-\x1f]").search


def latin_pattern(pattern: str) -> str:
    """The same pattern for the standard library, which is faster, for texts of characters below U+0250 alone."""
    of = lambda kind: "".join(f"\\u{c:04x}" for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)
    for kind in "LN":
        pattern = pattern.replace(f"[\\p{{{kind}}}]", f"[{of(kind)}]").replace(f"\\p{{{kind}}}", of(kind))
    return pattern


class WordBpe:
    def __init__(self, path: str, cached: int = 250_000):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.strings = {v: k for k, v in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        steps = {x["type"]: x for x in spec["pre_tokenizer"]["pretokenizers"]}
        self.pattern = steps["Split"]["pattern"]["Regex"]
        self.words = regex.compile(self.pattern).findall
        self.latin = re.compile(latin_pattern(self.pattern)).findall
        self.rare: tuple | None = None
        # the pair's ids, 32 bits each -> rank << 32 | id of the merge: the smallest value is the smallest rank
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in keep} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in keep)}
        self.inner = [vocab[names[b]] for b in range(256)]
        self.last = [vocab[names[b] + suffix] for b in range(256)]
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.cached = cached

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        parts = [self.inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        if len(parts) > LONG:
            return self._long(parts)
        get = self.merges.get
        ranks = [get(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) != _NONE:
            i = ranks.index(low)
            parts[i] = p = low & _ID
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | p, _NONE)
            if i < len(ranks):
                ranks[i] = get(p << 32 | parts[i + 1], _NONE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get(parts[i] << 32 | parts[i + 1]))]
        heapify(heap)
        while heap:
            low, i, a, b = heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = low & _ID, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := get(parts[x] << 32 | parts[y])):
                    heappush(heap, (m, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def ids_of(self, word: str) -> tuple[int, ...]:
        """merge() behind a cache of two generations, so that its size is bounded."""
        got = self.old.get(word)
        if got is None:
            got = tuple(self.merge(word.encode()))
        if len(word) <= 64:
            if len(self.young) >= self.cached:
                self.old, self.young = self.young, {}
            self.young[word] = got
        return got

    def _rare(self) -> tuple:
        """A finder of words and a lower-case table for texts with characters of the newest scripts.

        The regex module, unicodedata and the tokenizers library follow different versions of Unicode. For letters
        that regex has and unicodedata hasn't, the library's own normaliser and splitter say what they count as.
        """
        if self.rare is None:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(self.path)
            every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
            new = [c for c in regex.findall(r"\p{L}", every) if unicodedata.category(c) == "Cn"]
            table = {ord(c): low for c in new if (low := library.normalizer.normalize_str(c)) != c}
            ranges: list[list[int]] = [[0x10FFFF, 0x10FFFF]]
            for c in (ord(c) for c in new if len(library.pre_tokenizer.pre_tokenize_str(f"a{c}b")) > 1):
                if ranges[-1][1] == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
            letters = r"[\p{L}--[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]]"
            pattern = self.pattern.replace(r"[\p{L}]+", letters + "+").replace(r"[^\s\p{L}\p{N}]+", r"[^\s\p{N}" + letters + "]+")
            self.rare = regex.compile(pattern, regex.V1).findall, table
        return self.rare

    def _split(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        low = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()  # no final sigma: each character alone
        if not _OTHER(low):
            return self.latin(low)
        if not _LATER(low):
            return self.words(low)
        words, table = self._rare()
        return words(low.translate(table))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        have, ids_of = self.young.get, self.ids_of
        for part in self.split.split(text) if self.split and "<" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            for w in self._split(part):
                out += have(w) or ids_of(w)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(1)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array<int>) of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for b in slices(batches):
            ids = [np.array(bpe.encode(x or ""), np.int32) for x in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": pa.ListArray.from_arrays(ends, np.concatenate(ids))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds decoded, the text that the ids decode to; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(vocabulary)
        for b in slices(batches):
            text = [bpe.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": b.column("ids"), "decoded": pa.array(text, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = default_tokenizer("word_bpe_49k.json")
    out = decode_documents(encode_documents(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
