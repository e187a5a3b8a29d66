"""Vector bin packing of token pieces into sequences.

Every piece has a demand vector (tokens, segments, loss-bearing tokens), every sequence a capacity for each. A
sequence is filled by the dot-product heuristic (Panigrahy et al. 2011): of the waiting pieces that fit, take the
one whose demand has the largest dot product with the room left, both relative to the capacities. Documents are
cut where a sequence ends: pieces of full length fill sequences of their own, and where no waiting piece fits into
a room of at least min_cut tokens, the front of the longest one is cut off to fill it.

Packing is a map over the input's partitions: nothing is shuffled, a task holds at most `waiting` pieces, and
a lost task gives the same pieces again. Sequence ids are partition << 40 | number, so no two tasks share one.
Each task leaves at most a few sequences that aren't full.

Cases: a null or empty text is its end token alone; a null doc_id stays null; repeated rows are packed each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long, segment long"


class Packer:
    """Packs items (key, demand in tokens and loss-bearing tokens) one task at a time.

    limits: tokens, segments and loss-bearing tokens of a sequence. add() and finish() yield
    (sequence number, offset, segment, key, start, length); start counts from the item's first token.
    """

    def __init__(self, limits: tuple[int, int, int] = (2048, 256, 2048), min_cut: int = 16, waiting: int = 1024):
        self.limits, self.min_cut, self.waiting = np.array(limits, float), min_cut, waiting
        self.keys: list = []
        self.start, self.tokens, self.loss = (np.zeros(2 * waiting, np.int64) for _ in range(3))
        self.n = self.sequence = 0

    def add(self, key, tokens: int, loss: int) -> Iterator[tuple]:
        """loss: the item's last `loss` tokens bear loss."""
        start, full = 0, int(self.limits[0])
        while tokens - start >= full and min(loss, full) <= self.limits[2]:
            yield self.sequence, 0, 0, key, start, full
            self.sequence += 1
            start += full
        if start == tokens:
            return
        self._wait(key, start, tokens - start, max(0, min(loss, tokens - start)))
        while self.n >= self.waiting:
            yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while self.n:
            yield from self._fill()

    def _wait(self, key, start: int, tokens: int, loss: int) -> None:
        i = self.n
        if i == len(self.start):
            self.start, self.tokens, self.loss = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.tokens, self.loss))
        self.keys.append(key)
        self.start[i], self.tokens[i], self.loss[i] = start, tokens, loss
        self.n += 1

    def _take(self, i: int) -> None:
        last = self.n - 1
        self.keys[i] = self.keys[last]
        self.keys.pop()
        for x in (self.start, self.tokens, self.loss):
            x[i] = x[last]
        self.n = last

    def _fill(self) -> Iterator[tuple]:
        room, offset, segment = self.limits.copy(), 0, 0
        while self.n and room[0] >= 1 and room[1] >= 1:
            t, x = self.tokens[: self.n], self.loss[: self.n]
            part = room / self.limits
            value = t * (part[0] / self.limits[0]) + part[1] / self.limits[1] + x * (part[2] / self.limits[2])
            value[(t > room[0]) | (x > room[2])] = -1.0
            i = int(value.argmax())
            if value[i] >= 0:
                length, loss = int(t[i]), int(x[i])
                yield self.sequence, offset, segment, self.keys[i], int(self.start[i]), length
                self._take(i)
            else:
                if segment and room[0] < self.min_cut:
                    break
                i = int(t.argmax())
                free = int(t[i] - x[i])  # tokens before the loss-bearing ones
                length = int(min(t[i], room[0], free + room[2]))
                if length < 1:
                    break
                loss = max(0, length - free)
                yield self.sequence, offset, segment, self.keys[i], int(self.start[i]), length
                if length == t[i]:
                    self._take(i)
                else:
                    self.start[i] += length
                    self.tokens[i] -= length
                    self.loss[i] = min(self.loss[i] - loss, self.tokens[i])
            room -= (length, 1, loss)
            offset += length
            segment += 1
        self.sequence += 1


@lru_cache(2)
def byte_encoder(path: str):
    """A function text -> ids, for a byte-level BPE file of the tokenizers library.

    The ids are that library's (a test compares both over all code points); tiktoken's engine runs the same
    merges several times faster. The file's special strings are single ids, as there.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    more = [b for b in range(256) if b not in keep]
    byte = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(more)}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    name = base64.b16encode(path.encode()).decode()
    engine = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    # without white space beside white space the look-ahead changes nothing, and matching needs no backtracking
    plain = tiktoken.Encoding(f"{name}-plain", pat_str=pattern.replace(r"\s+(?!\S)|", ""), mergeable_ranks=ranks, special_tokens=special)
    marks, spaces, none = tuple(special), re.compile(r"\s\s").search, frozenset()

    def encode(text: str) -> np.ndarray:
        if any(m in text for m in marks):
            return engine.encode_to_numpy(text, allowed_special="all")
        return (engine if spaces(text) else plain).encode_to_numpy(text, disallowed_special=none)

    return encode


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: tuple[int, int, int] = (2048, 256, 2048), min_cut: int = 16, waiting: int = 1024, loss_column: str | None = None) -> DataFrame:
    """One row a piece: its ids (little-endian 32 bits), place in the document and place in its sequence.

    docs: doc_id, text, and with loss_column the number of last tokens that bear loss (null: all).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = byte_encoder(tokenizer), Packer(limits, min_cut, waiting)
        high = TaskContext.get().partitionId() << 40
        waiting_ids: dict[int, list] = {}  # ids of documents with pieces that aren't placed: [doc_id, ids, tokens left]

        def rows(placed: Iterable[tuple]) -> Iterator[tuple]:
            for sequence, offset, segment, key, start, length in placed:
                entry = waiting_ids[key]
                doc, ids, _, loss = entry
                entry[2] -= length
                if not entry[2]:
                    del waiting_ids[key]
                first = max(start, len(ids) - loss)
                yield doc, start, length, ids[start : start + length].tobytes(), len(ids), max(0, start + length - first), high | sequence, offset, segment

        def table_of(got: list[tuple]) -> pa.RecordBatch:
            names = [x.split()[0] for x in PIECES.split(", ")]
            kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names=names)

        n = 0
        for b in slices(batches):
            got: list[tuple] = []
            loss = b.column("loss").to_pylist()
            for doc, text, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), loss, strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                x = len(ids) if x is None else max(0, min(x, len(ids)))
                waiting_ids[n] = [doc, ids, len(ids), x]
                got += rows(packer.add(n, len(ids), x))
                n += 1
            if got:
                yield table_of(got)
        if got := list(rows(packer.finish())):
            yield table_of(got)

    loss = F.col(loss_column).cast("long") if loss_column else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), loss.alias("loss")).mapInArrow(run, PIECES)


def default_tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_vector_packing(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    pieces = pack_documents(docs, default_tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "segment")
