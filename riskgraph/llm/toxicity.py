"""Toxicity with noisy-channel deobfuscation: decode what a text says, then score the decoded text.

Character language model: trigrams of letters within words, counted over all documents (labels play no part).
Channel: a written character stands for one of several letters at a cost (4 or @ for a, 1 or ! for i or l, ...), a run
of one letter for one or two of it, a separator between single characters for nothing or for the edge of a word. Each suspicious span (leet
characters before a letter, single letters spelt out, runs of three) becomes a lattice of bytes, and Viterbi search finds
the cheapest letters under channel and model, exactly, over states of the last two letters. Trigrams find few of the word
edges in a spelt-out span, so it is also decoded without edges and read from each of its characters on. All else stays.
Spans are found in time linear in the text, decoded in time linear in the span, and put back where they stood: the scored
text is the restored one.

Scorer: logistic regression over hashed words of the decoded text and their beginnings (4 to 7 bytes), each counted once a
document. It learns from at most `sample` labelled rows of the training fold (all toxic and clean rows by the order of a
hash); only features that at least `support` training documents have, and that are at least `odds` times as frequent in
toxic ones, carry weight, so long clean texts gather nothing. labels, lang, source and doc_id are never inputs of a score.

Cases: null and empty texts have no features and get the scorer's base; a null doc_id counts as the empty string for the
fold and has no label; a doc_id with several labels counts once for each; null labels are ignored; without
labels of both kinds every score is 0; repeated rows each get a row; an empty table gives an empty result; other
columns stay where a stage filters, and are ignored elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _POW, _TABLE, _powers, forget, free_name, mix, slices, stored, table
from .features import Linear, fit_logistic

BITS = 20
_U = np.uint64
#: What a written character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
_SWAP, _DROP, _EDGE, _DOUBLE, _SINGLE = 1.0, 0.3, 1.6, 0.5, 0.5
_BETWEEN = " ._*-"
_READ = 16  # bytes of a reading, beyond what features look at
_L = "a-zß-ɏ"
_C = rf"[{_L}0-9@$!|+]"
# single characters spelt out; of such a span at least one must be a letter
_SPELT = re.compile(rf"(?<![{_L}0-9]){_C}(?:[ ._*-]{_C}){{2,}}(?![{_L}0-9])")
# what makes a run of letters and leet characters suspicious: leet before a letter, a run of three, leet at the end
_ODD = re.compile(rf"[0-9@$!|+][{_L}]|([{_L}])\1\1|[{_L}][0-9@$]+(?![0-9@$!|+%#&*])")
_RUN = re.compile(rf"{_C}+")
_IN_RUN = re.compile(_C).match
_LETTER = re.compile(rf"[{_L}]").search


def suspicious(text: str) -> list[tuple[int, int]]:
    """(start, end) of the spans to decode, in order, none within another."""
    spans = [m.span() for m in _SPELT.finditer(text) if _LETTER(m[0])]
    k, at = 0, 0
    while m := _ODD.search(text, at):
        lo, hi = m.start(), _RUN.match(text, m.start()).end()
        while lo > at and _IN_RUN(text[lo - 1]):
            lo -= 1
        at = hi
        while hi > m.end() and text[hi - 1] in "!|+":  # marks after a word
            hi -= 1
        while k < len(spans) and spans[k][1] <= lo:
            k += 1
        end = k
        while end < len(spans) and spans[end][0] < hi:  # a spelt-out span that goes on in the run is one with it
            lo, hi, end = min(lo, spans[end][0]), max(hi, spans[end][1]), end + 1
        spans[k:end] = [(lo, hi)]
    return spans


# classes of bytes: 1-26 letters, 0 the edge of a word, 27-58 the bytes of other letters
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = 27 + (np.arange(128, 256) & 31)
_N = 59


def lower(b: pa.RecordBatch) -> list[str]:
    return [(x or "").lower() for x in b.column("text").to_pylist()]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.encode() for x in texts]
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])]).astype(np.int64)


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """(59, 59, 59) counts over all texts; classes as above. The result's size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3, np.int64)
        for b in slices(batches):
            c = np.concatenate([[0, 0], _CLASS[_joined(lower(b))[0]]])
            c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]  # one edge between words
            total += np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:], minlength=_N**3)
        at = np.flatnonzero(total)
        yield pa.record_batch({"code": at, "n": total[at]})

    got = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_N**3)
    out[got["code"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return out.reshape(_N, _N, _N)


class Channel:
    """Viterbi decoding under the trigram model. restore() is a function of the span alone, and is cached."""

    def __init__(self, counts: np.ndarray, cached: int = 100_000):
        one = (counts.sum((0, 1)) + 0.1) / (counts.sum() + 0.1 * _N)
        two = (counts.sum(0) + 5 * one) / (counts.sum(0).sum(1, keepdims=True) + 5)
        self.cost = -np.log((counts + 5 * two) / (counts.sum(2, keepdims=True) + 5))
        self.have: dict[str, tuple[str, str]] = {}
        self.cached = cached

    def restore(self, span: str) -> tuple[str, str]:
        """The best letters with word edges; of a spelt-out span also the best without, read from each character on."""
        got = self.have.get(span)
        if got is None:
            got = b"".join(self._decode(span, True)).decode(errors="replace"), ""
            if any(c in _BETWEEN for c in span):
                said = self._decode(span, False)
                starts = [0, *(k + 1 for k, x in enumerate(said) if not x)]
                got = got[0], " ".join(b"".join(said[k : k + 2 * _READ])[:_READ].decode(errors="ignore") for k in starts)
            if len(span) > 200:  # too long to keep
                return got
            if len(self.have) >= self.cached:
                self.have.clear()
            self.have[span] = got
        return got

    def _lattice(self, span: str, edges: bool) -> list[list[tuple[float, bytes]]]:
        """Per run of equal characters, what it may stand for with its cost."""
        out = []
        for m in re.finditer(r"(.)\1*", span, re.S):
            c, n = m[1], len(m[0])
            if c in LEET:
                out.append([(_SWAP * n, x.encode() * k) for x in LEET[c] for k in ((1,) if n == 1 else (1, 2))])
            elif c.isalpha():
                out.append([(0.0, c.encode())] if n == 1 else [(_SINGLE if n == 2 else 0.3, c.encode()), (0.0 if n == 2 else _DOUBLE, c.encode() * 2)])
            elif c in _BETWEEN:
                out.append([(_DROP, b""), (_EDGE, b" ")] if edges else [(_DROP, b"")])
            else:
                out.append([(0.0, c.encode() * n)])
        return out

    def _decode(self, span: str, edges: bool) -> list[bytes]:
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for step in self._lattice(span, edges):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (z, before) in best.items():
                for price, add in step:
                    x, y, cost = a, b, z + price
                    for c in add:
                        k = int(_CLASS[c])
                        cost += self.cost[x, y, k]
                        x, y = y, k
                    old = new.get((x, y))
                    if old is None or cost < old[0]:
                        new[x, y] = (cost, (before, add))
            best = new
        at = min(((z + self.cost[a, b, 0], before) for (a, b), (z, before) in best.items()), key=lambda x: x[0])[1]
        said = []
        while at is not None:
            at, add = at
            said.append(add)
        return said[::-1]

    def text(self, text: str) -> str:
        """The text with every suspicious span decoded, and readings of the spelt-out ones after it."""
        spans = suspicious(text)
        if not spans:
            return text
        out, said, at = [], [], 0
        for lo, hi in spans:
            meant, read = self.restore(text[lo:hi])
            out += [text[at:lo], meant]
            said += [read] if read else []
            at = hi
        return "".join([*out, text[at:], "\n", " ".join(said)])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of lower-case texts, (text, place): words and their first 4 to 7 bytes."""
    data, off = _joined(texts)
    doc_of = np.repeat(np.arange(len(texts)), np.diff(off))
    solid = _CLASS[data] > 0
    start = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
    stop = np.flatnonzero(solid & np.concatenate([~solid[1:], [True]])) + 1
    found = []
    for lo in range(0, len(start), 1 << 14):
        s, e = start[lo : lo + (1 << 14)], stop[lo : lo + (1 << 14)]
        if not len(s):
            continue
        base, end = s[0], e[-1]
        _powers(int(end - base) + 1)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(_TABLE[False][data[base:end]] * _POW["up"][: end - base])])
        a, size = s - base, e - s
        down, doc = _POW["down"][a], doc_of[s].astype(_U)
        for k in (4, 5, 6, 7, 0):
            ok = size >= (k or 1)
            to = (a + (k or size))[ok]
            h = mix((sums[to] - sums[a[ok]]) * down[ok] + _U(k)) & _U((1 << BITS) - 1)
            found.append(np.unique(doc[ok] << _U(BITS) | h))
    key = np.unique(np.concatenate(found)) if found else np.zeros(0, _U)
    return (key >> _U(BITS)).astype(np.int64), (key & _U((1 << BITS) - 1)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray, sample: int = 20_000, support: int = 4, odds: float = 6.0, toxic_weight: float = 0.8) -> Linear:
    """docs: doc_id, text; labels: doc_id, toxic. Only labelled rows of the training fold are looked at.

    toxic_weight: the share of the loss that the toxic documents have together, whatever their number.
    """
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    fold = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    fold = fold.filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id", F.lit(5))).orderBy("h").limit(sample).select("doc_id", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(sent.value)
        for b in slices(batches):
            doc, place = features([channel.text(x) for x in lower(b)])
            ends = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            # a bounded description a document: what each place's counts need, summed by Spark
            yield pa.record_batch({"toxic": b.column("toxic"), "place": pa.ListArray.from_arrays(ends, place.astype(np.int32))})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(fold, "doc_id").select("text", "toxic")
    rows = stored(own.mapInArrow(run, "toxic int, place array<int>"))
    bad = F.sum((F.col("toxic") > 0).cast("int"))
    n1, n0 = (x or 0 for x in rows.agg(bad, F.sum((F.col("toxic") <= 0).cast("int"))).first())
    zero = Linear(np.zeros(1 << BITS), -40.0)
    if not n1 or not n0:
        return zero
    per = rows.select("toxic", F.explode("place").alias("place")).groupBy("place").agg(bad.alias("t"), F.count(F.lit(1)).alias("n"))
    rate = ((F.col("t") + 0.5) / n1) / ((F.col("n") - F.col("t") + 0.5) / n0)
    told = per.filter((F.col("t") >= support) & (rate >= odds) & (F.col("t") * 4 >= F.col("n"))).select("place").toPandas()["place"].to_numpy(np.int64)
    keep = np.zeros(1 << BITS, bool)
    keep[told] = True
    chosen = docs.sparkSession.sparkContext.broadcast(keep)

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = [x[chosen.value[x]] for x in (np.asarray(v, np.int64) for v in b.column("place").to_pylist())]
            yield pa.record_batch({"toxic": b.column("toxic"), "place": pa.array([x.tolist() for x in place], pa.list_(pa.int32()))})

    got = rows.mapInArrow(only, "toxic int, place array<int>").toPandas()
    size = got["place"].map(len).to_numpy()
    doc, place = np.repeat(np.arange(len(got)), size), np.concatenate([np.zeros(0, np.int64), *got["place"].tolist()]).astype(np.int64)
    forget(rows)
    y = (got["toxic"].to_numpy() > 0).astype(float)
    used, near = np.unique(place, return_inverse=True)
    few = fit_logistic(doc, near, np.ones(len(place)), y, len(used), weight=np.where(y > 0, toxic_weight / n1, (1 - toxic_weight) / n0), decay=1e-5)
    weights = np.zeros(1 << BITS)
    weights[used] = few.weights
    return Linear(weights, few.bias)


def score(docs: DataFrame, scorer: Linear, counts: np.ndarray, name: str = "_score") -> DataFrame:
    """Adds the score as column `name` to all rows and columns of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((scorer, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, counts = sent.value
        channel = Channel(counts)
        for b in slices(batches):
            doc, place = features([channel.text(x) for x in lower(b)])
            value = scorer.score(doc, place, np.ones(len(place)), b.num_rows)
            yield pa.record_batch([*b.columns, pa.array(value, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_clean(docs: DataFrame, labels: DataFrame, below: float = 0.7) -> DataFrame:
    """The rows that score less than `below`, with the columns of docs, whatever their names."""
    counts, name = trigram_counts(docs), free_name(docs, "_score")
    return score(docs, train(docs, labels, counts), counts, name).filter(F.col(name) < below).drop(name)


def op9_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = trigram_counts(docs)
    out = score(docs, train(docs, table(spark, sf_dir, "labels"), counts), counts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))
