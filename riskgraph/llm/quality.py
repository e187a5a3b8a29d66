"""Quality classifier without hand labels: a weak-label model over heuristic labellers, then a hashed linear scorer.

Each labeller looks at one side of a text (repeats, symbols stuck to words, capitals, table bars, words of odd length,
...) and votes good (1), bad (0) or nothing (-1). Votes of all documents are counted by pattern: at most 3 to
the number of labellers rows, whatever the input's size. Expectation-maximisation (Dawid and Skene's model) over the
counted patterns estimates each labeller's accuracies for good and bad texts and the share of good ones; every pattern
then has a posterior. The posterior labels of a bounded sample (`sample` documents in the order of a hash of the text,
so any size of input gives as many) train a logistic scorer over hashed features: quantised text statistics and
word shapes. All documents are scored by it.

Cases: null and empty texts count as bad: no labeller votes for them but the one on length; they are scored like any
text. A null doc_id stays; repeated rows each get a row; an empty table gives an empty result; other columns stay
where a stage filters, and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _SPACE, free_name, large_binary_column, mix, slices, table, word_hashes
from .features import Linear, fit_logistic

BITS = 14
LABELLERS = ["length", "repeats", "symbols", "capitals", "bars", "variety", "sentences", "runs", "prose", "plain"]
_U = np.uint64

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?!)\"'"]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~!"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LETTER = _UPPER | _LOWER
_LETTER[128:] = True
_PROSE = _LETTER | _STOP
_PROSE[48:58] = True


def statistics(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Per text: shares of its words that are odd in one way each. All are in [0, 1] but words and run."""
    data, off = large_binary_column(b, "text")
    n = len(off) - 1
    h, at = word_hashes(data, off, fold=True)
    words = np.diff(at)
    doc = np.repeat(np.arange(n), words)
    each = np.maximum(words, 1)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(solid & (np.concatenate([[True], ~solid[:-1]]) | edge[:-1]))
    stops = np.flatnonzero(solid & (np.concatenate([~solid[1:], [True]]) | edge[1:])) + 1
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    per = lambda flags: np.bincount(doc, flags, n) / each
    symbols, upper, lower, letters, prose = (sums(t[data]) for t in (_SYMBOL, _UPPER, _LOWER, _LETTER, _PROSE))
    within = lambda s: s[stops] - s[starts]
    size = stops - starts
    last = data[np.maximum(stops - 1, 0)] if len(stops) else data[:0]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    # distinct words: sorted keys of the text's number and the rest of the word's hash
    bits = _U(max(1, n.bit_length()))
    keys = np.sort((h >> bits) | (doc.astype(_U) << (_U(64) - bits)))
    fresh = (keys[np.concatenate([[True], keys[1:] != keys[:-1]])] >> (_U(64) - bits)).astype(np.int64) if len(keys) else doc
    # the longest run of one word, from the places where a word differs from the one before
    begin = np.flatnonzero(~same)
    run = np.zeros(n, np.int64)
    if len(begin):
        np.maximum.at(run, doc[begin], np.diff(np.append(begin, len(h))))
    return {
        "words": words, "repeats": per(same), "symbols": per((within(symbols) > 0) & (size > 1) & _SYMBOL[last]),
        "capitals": per((within(upper) > 1) & (within(lower) == 0)), "bars": per((size == 1) & (last == ord("|"))),
        "fresh": np.bincount(fresh, minlength=n) / each, "stops": per(np.isin(last, [ord(c) for c in ".?!"]) & (within(symbols) == 0)),
        "long": per(size > 24), "run": run, "plain": per((within(letters) == size) | ((within(letters) == size - 1) & _STOP[last])),
        "prose": np.bincount(doc, within(prose), n) / np.maximum(np.bincount(doc, size, n), 1),
    }


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, labellers) of 1 good, 0 bad, -1 no vote."""
    words = s["words"]

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good & (words > 0), 1, -1))

    # a text of n words is expected to repeat more of them the longer it is
    common = np.clip(1.05 - 0.1 * np.log10(np.maximum(words, 1)), 0.0, 1.0)
    often = lambda name, share: (s[name] > share) & (s[name] * words >= 3)  # noqa: E731  in a short text one odd word says little
    return np.stack([
        vote(words < 3, words >= 20),
        vote(often("repeats", 0.05), s["repeats"] < 0.01),
        vote(often("symbols", 0.02), s["symbols"] < 0.005),
        vote(often("capitals", 0.1), s["capitals"] < 0.02),
        vote(often("bars", 0.02), s["bars"] == 0),
        vote((words >= 30) & (s["fresh"] < 0.35 * common), s["fresh"] > 0.6 * common),
        vote((words >= 60) & (s["stops"] < 0.005), (words >= 10) & (s["stops"] > 0.02)),
        vote((s["run"] >= 5) | often("long", 0.3), s["run"] <= 2),
        vote((words >= 10) & (s["prose"] < 0.9), s["prose"] > 0.95),
        vote((s["plain"] < 0.8) & ((1 - s["plain"]) * words >= 8), s["plain"] > 0.9),
    ], 1)


def features(b: pa.RecordBatch, s: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features (text, place, value): each statistic's bin, and pairs of the bins of the odd ones."""
    s = s or statistics(b)
    n = len(s["words"])
    cols = []
    for k, (name, x) in enumerate(s.items()):
        bins = np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) if name in ("words", "run") else np.searchsorted([0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8], x)
        cols.append(bins.astype(np.int64).astype(_U) + _U(1000 * (k + 1)))
    words = cols[0]
    cols += [mix(c * _U(0x9E3779B97F4A7C15)) ^ words for c in cols[1:]]
    place = np.stack([mix(c) for c in cols], 1) % _U(1 << BITS)
    return np.repeat(np.arange(n), place.shape[1]), place.ravel().astype(np.int64), np.ones(place.size)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, accuracies [labeller, class], share of good) from counted vote patterns.

    accuracies[l, y] is the chance that labeller l, if it votes, votes y for a text of class y. The start says what is
    known of such labellers: each sees one of many defects, so it misses most bad texts, and seldom condemns a good
    one. That names the classes; small added counts keep the chances inside (0, 1).
    """
    cast = patterns >= 0
    good = patterns == 1
    acc, share = np.tile([0.3, 0.998], (patterns.shape[1], 1)), 0.8
    post = np.full(len(patterns), share)
    for _ in range(rounds):
        p1 = np.where(good, acc[:, 1], 1 - acc[:, 1])
        p0 = np.where(good, 1 - acc[:, 0], acc[:, 0])
        z = np.log(share / (1 - share)) + np.where(cast, np.log(p1) - np.log(p0), 0.0).sum(1)
        new = 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
        w1, w0 = counts * new, counts * (1 - new)
        acc[:, 1] = ((w1[:, None] * (cast & good)).sum(0) + 0.998) / ((w1[:, None] * cast).sum(0) + 1)
        acc[:, 0] = ((w0[:, None] * (cast & ~good)).sum(0) + 0.3) / ((w0[:, None] * cast).sum(0) + 1)
        share = (w1.sum() + 0.8) / (counts.sum() + 1)
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, acc, float(share)


def _code(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def weak_labels(docs: DataFrame) -> tuple[dict[int, float], np.ndarray, float]:
    """(posterior by pattern code, accuracies, share of good) from the votes on all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), np.int64)
        for b in slices(batches):
            total += np.bincount(_code(votes(statistics(b))), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch({"code": at, "n": total[at]})

    got = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    code, n = got["code"].to_numpy(np.int64), got["n"].to_numpy(float)
    patterns = code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    post, acc, share = expectation_maximisation(patterns, n)
    return dict(zip(code.tolist(), post.tolist(), strict=True)), acc, share


def train(docs: DataFrame, sample: int = 20_000) -> tuple[Linear, dict[int, float]]:
    """The scorer and the patterns' posteriors. docs: text. sample: the most texts that the scorer is fitted on."""
    posterior, _, _ = weak_labels(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = statistics(b)
            doc, place, _ = features(b, s)
            ends = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.record_batch({"h": b.column("h"), "code": _code(votes(s)), "place": pa.ListArray.from_arrays(ends, place.astype(np.int32))})

    # each text once, by its hash: about twice the bound is looked at, and the smallest hashes are taken
    hashed = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text", F.lit(11)))
    n = max(1, hashed.agg(F.count_distinct("h")).first()[0])
    limit = min(1.0, 2.0 * sample / n)
    some = hashed.filter(F.pmod("h", F.lit(1 << 20)) < int(limit * (1 << 20)) + 1).dropDuplicates(["h"])
    got: pd.DataFrame = some.mapInArrow(run, "h long, code long, place array<int>").orderBy("h").limit(sample).toPandas()
    if not len(got):
        return Linear(np.zeros(1 << BITS), 0.0), posterior
    size = got["place"].map(len).to_numpy()
    target = got["code"].map(posterior).to_numpy(float)
    doc, place = np.repeat(np.arange(len(got)), size), np.concatenate(got["place"].to_numpy())
    return fit_logistic(doc, place, np.ones(len(place)), target, 1 << BITS), posterior


def score(docs: DataFrame, scorer: Linear, posterior: dict[int, float], names: tuple[str, str] = ("_weak", "_score")) -> DataFrame:
    """Adds the votes' posterior and the scorer's score, by these names, to all rows and columns of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((scorer, posterior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, posterior = sent.value
        for b in slices(batches):
            s = statistics(b)
            weak = np.array([posterior.get(c, 0.5) for c in _code(votes(s)).tolist()])
            value = scorer.score(*features(b, s), b.num_rows)
            yield pa.record_batch([*b.columns, pa.array(weak, pa.float64()), pa.array(value, pa.float64())], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(x, T.DoubleType()) for x in names)]))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose score is at least `least`, with the columns of docs, whatever their names."""
    names = free_name(docs, "_weak"), free_name(docs, "_score")
    return score(docs, *train(docs), names).filter(F.col(names[1]) >= least).drop(*names)


def op6_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(docs, *train(docs))
    return out.select("doc_id", F.col("_weak").alias("weak_label"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("keep"))
