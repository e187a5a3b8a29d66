"""Suffix tree, quality, toxicity and the pipeline: exact bases, held-out accuracy, awkward rows."""

import collections
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskgraph.llm import lm_scoring, quality
from riskgraph.llm.common import trim
from riskgraph.llm.features import Linear
from riskgraph.llm.lm_scoring import op1_suffix_tree
from riskgraph.llm.quality import keep_good, op6_weak_labels
from riskgraph.llm.bagminhash import keep_one
from riskgraph.llm.toxicity import _CLASS, Channel, keep_clean, op9_noisy_channel, suspicious, trigram_counts

from .cases import awkward, empty, write

DIR = "/root/testdata/sf0.001"


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), None]


def check_bases(docs, got):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs}
    count = collections.Counter(w for d, t in docs if not held[d] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), held[d], len(w := tokens(t)), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 5)) for d, t in docs)
    assert want == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got)


def plain_scores(docs, depth=3, least=2, min_gain=12.0, discount=0.75):
    """doc_id -> log10 probability by dictionaries of whole sequences, with the longest context of the tree for each token."""
    train = [tokens(t) for d, t in docs if zlib.crc32(str(d).encode()) % 7 != 2]
    count = collections.Counter(tuple(x[i : i + n]) for x in train for n in range(1, depth + 2) for i in range(len(x) - n + 1))
    total, distinct = sum(c for k, c in count.items() if len(k) == 1), sum(len(k) == 1 for k in count)
    held = {k: c for k, c in count.items() if c >= least or len(k) == 1}
    p = {k: (c + 1) / (total + distinct + 1) for k, c in held.items() if len(k) == 1}
    left, gain, cost, grown = {}, {}, {}, {(): True}
    for n in range(2, depth + 2):
        own = collections.defaultdict(list)
        for k, c in held.items():
            if len(k) == n and grown.get(k[1:-1], False):
                own[k[:-1]].append((k, c))
        for s, pairs in own.items():
            left[s] = max(1 - sum(c - discount for _, c in pairs) / count[s], 1e-12)
            for k, c in pairs:
                p[k] = (c - discount) / count[s] + left[s] * p[k[1:]]
            cost[s] = -sum(c * math.log(p[k]) for k, c in pairs)
            gain[s] = sum(c * math.log(p[k] / p[k[1:]]) for k, c in pairs) + max(count[s] - sum(c for _, c in pairs), 0) * math.log(left[s])
            grown[s] = cost[s] >= min_gain
    tree = set()
    for s in sorted(gain, key=len, reverse=True):
        if gain[s] >= min_gain or s in tree:
            tree |= {s[k:] for k in range(len(s))}

    def prob(s, x):
        while s and s not in tree:
            s = s[1:]
        if not s:
            return p.get((x,), 1 / (total + distinct + 1))
        return p[(*s, x)] if (*s, x) in p else left[s] * prob(s[1:], x)

    return {d: sum(math.log10(prob(tuple(w[max(0, i - depth) : i]), x)) for i, x in enumerate(w)) for d, t in docs for w in [tokens(t)]}


def test_suffix_tree_scores_against_dictionaries(spark, monkeypatch):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_scores(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", "text", lm_scoring.held_out(F.col("doc_id")).alias("held_out"))
    tree = lm_scoring.train(df.filter("not held_out"))
    for bound in (1 << 20, 1000):  # all in the head; most in the shuffle
        got = {r.doc_id: r.score for r in lm_scoring.score(df, tree, bound).collect()}
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 * max(1, abs(want[d])) for d in want)


def test_small_numbers_pack_and_blobs_go_in_blocks():
    """What travels for a text's rare words packs to little more than its hashes; a bucket is met in blocks; freed memory goes back."""
    rng = np.random.default_rng(5)
    n = 40_000
    h, row, times = rng.integers(0, 2**64, n, np.uint64), np.sort(rng.integers(0, n // 3, n)) + (5 << 33), rng.integers(1, 9, n).astype(np.int32)
    got = dict(lm_scoring._dealt(lm_scoring._bucket(h, 4), *lm_scoring._short(h), row, times, steps=2))
    raw = b"".join(got.values())
    assert len(pa.compress(raw, "lz4", asbytes=True)) < 9 * n and len(raw) == 18 * n
    blobs = pa.chunked_array([pa.array([None, *got.values()], pa.binary())])
    blocks = list(lm_scoring._blocks(blobs, most=2 * len(raw) // 16))
    assert 4 < len(blocks) < 16 and sum(len(x) for x in blocks) == 16
    back = [np.concatenate(x) for x in zip(*(lm_scoring._undealt(b, "<u4", "<u2", "<i8", "<i4", steps=2) for b in blocks), strict=True)]
    want = [*lm_scoring._short(h), row, times]
    order = np.argsort(lm_scoring._bucket(h, 4), kind="stable")
    assert all((a == b[order]).all() for a, b in zip(back, want, strict=True))
    assert [len(x) for x in lm_scoring._undealt([], "<u4", "<i8")] == [0, 0]
    pages = lambda: int(open("/proc/self/statm").read().split()[1])
    held = [np.ones(12_000) for _ in range(800)]
    held, most = held[-1:], pages()
    trim()
    assert most - pages() > 10_000  # of 19,000


def test_suffix_tree(spark, tmp_path):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = op1_suffix_tree(spark, DIR).collect()
    check_bases(docs, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    odd = awkward(spark)
    check_bases([(r.doc_id, r.text) for r in odd.collect()], op1_suffix_tree(spark, write(spark, tmp_path, odd)).collect())
    assert op1_suffix_tree(spark, write(spark, tmp_path, empty(spark))).count() == 0


def test_suffix_tree_keeps_rare_states_of_a_large_corpus(spark, tmp_path):
    # 24 of 4 million tokens: far below a share of 2**-16, which a state needed before
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, F.repeat(F.lit("x "), 100_000)).otherwise("alpha beta").alias("text"))
    got = op1_suffix_tree(spark, write(spark, tmp_path, docs)).filter("doc_id >= 40").collect()
    assert len(got) == 24 and all(r.score - r.base_score > 8 for r in got)


def test_quality_against_labels(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    both = op6_weak_labels(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("keep", "quality").collect()
    good = [r.keep for r in both if r.quality]
    bad = [r.keep for r in both if not r.quality]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.1
    odd = awkward(spark)
    assert op6_weak_labels(spark, write(spark, tmp_path, odd)).count() == odd.count() and keep_good(odd).columns == odd.columns
    assert op6_weak_labels(spark, write(spark, tmp_path, empty(spark))).count() == 0


def test_quality_samples_each_text_once(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(quality, "fit_logistic", lambda doc, place, value, target, size: fitted.append(len(target)) or Linear(np.zeros(size), 0.0))
    docs = spark.range(210).select(F.when(F.col("id") < 200, "the same words again").otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"))
    quality.train(docs, sample=20)
    assert fitted == [11]


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    both = op9_noisy_channel(spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    toxic = [r.predicted for r in both if r.toxic]
    clean = [r.predicted for r in both if not r.toxic]
    assert sum(toxic) / len(toxic) >= 0.9 and sum(clean) / len(clean) <= 0.01


def test_toxicity_of_awkward_rows(spark, tmp_path):
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    write(spark, tmp_path, labels, "labels")
    odd = awkward(spark)
    got = op9_noisy_channel(spark, write(spark, tmp_path, odd)).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 3 == 1
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id) for r in got)
    assert op9_noisy_channel(spark, write(spark, tmp_path, empty(spark))).count() == 0


def test_stages_take_clashing_columns_and_awkward_rows(spark):
    """Texts that are equal share a fate, all columns stay, and nothing is invented."""
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    clash = {c: F.lit(k) for k, c in enumerate(["_score", "_Weak", "key", "row", "size", "_score_"])}
    odd = awkward(spark).withColumns(clash)
    key = lambda rows: sorted((str(r.doc_id), r.text or "") for r in rows)
    every = key(odd.collect())
    for stage in (keep_good, lambda d: keep_clean(d, labels), keep_one):
        out = stage(odd)
        got = out.collect()
        assert out.columns == odd.columns and set(key(got)) <= set(every)
        assert all((r["_score"], r["_Weak"], r["key"], r["size"], r["_score_"]) == (0, 1, 2, 4, 5) for r in got)
        assert stage(odd.limit(0)).count() == 0
    assert key(keep_clean(odd, labels.limit(0)).collect()) == every  # without labels nothing is toxic
    assert len({t for _, t in key(keep_one(odd).collect())}) == len({t for _, t in every}) == keep_one(odd).count()


@pytest.fixture(scope="module")
def channel(spark):
    return Channel(trigram_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))


def test_channel_restores_what_was_written(channel):
    for said, meant in (("1d10t", "idiot"), ("l.o.s.e.r", "loser"), ("m0r0n", "moron"), ("tr@$h", "trash"), ("p4th3t1c", "pathetic"), ("l0ser!!", "loser!!")):
        assert channel.text(f"so {said} it is").split("\n")[0] == f"so {meant} it is"


def test_channel_decodes_spans_of_any_length(channel):
    assert channel.text("l" + "o" * 210 + "ser").split("\n")[0] == "loser"
    assert channel.text(" ".join("stupid" * 1000)).split("\n")[0].replace(" ", "") == "stupid" * 1000
    assert channel.text("1d10t" * 4000).split("\n")[0] == "idiot" * 4000


def test_spans_are_found_in_linear_time():
    n = 1_000_000
    for text in ("x1y " + "abcde" * (n // 5), "a1" * (n // 2), "a" * n, "0 1 " * (n // 4) + "x", "1" * n, "a" + "1" * n + "%"):
        began = time.time()
        suspicious(text)
        assert time.time() - began < 2


@pytest.mark.parametrize("said, meant", [("you are a m o r o n", "moron"), ("he is a s t u p i d fool", "stupid"), ("a l.o.s.e.r", "loser"), ("1 d i o t", "idiot"), ("s t u p i d m o r o n", "moron")])
def test_channel_finds_words_in_spelt_out_spans(channel, said, meant):
    assert meant in channel.text(said).split()


def test_suspicious_spans():
    for text, spans in (
        ("so dumba$$ it is", ["dumba$$"]), ("a$$", ["a$$"]), ("idi07", ["idi07"]), ("tra54", ["tra54"]), ("wow!!! it costs 50% of 1,200", []), ("sooo m0r0n", ["sooo", "m0r0n"]),
        ("a b c 1", ["a b c 1"]), ("1 2 3 4", []), ("1 d 1 0 t says l0ser!", ["1 d 1 0 t", "l0ser"]), ("mp3% x", []),
    ):
        assert [text[a:b] for a, b in suspicious(text)] == spans
    pick = random.Random(7)
    for _ in range(20_000):
        text = "".join(pick.choices("ab1$@!|+ .-%é", k=pick.randint(1, 12)))
        spans = suspicious(text)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        covered = {k for a, b in spans for k in range(a, b)}
        assert all(m.start() in covered for m in re.finditer(r"[0-9@$!|+][a-zé]", text))


def test_viterbi_against_all_paths(channel):
    """The cheapest reading of short lattices, by trying every one."""
    for span in ("1d10t", "m0r0n", "l.o.s", "aaa1", "4.5.5", "s-c-u-m", "tr@$h"):
        for edges in (True, False):
            best = None
            for path in itertools.product(*channel._lattice(span, edges)):
                a = b = 0
                cost = 0.0
                for price, add in path:
                    cost += price
                    for c in add:
                        k = int(_CLASS[c])
                        cost += channel.cost[a, b, k]
                        a, b = b, k
                cost += channel.cost[a, b, 0]
                best = min(best, (cost, b"".join(x for _, x in path))) if best else (cost, b"".join(x for _, x in path))
            assert b"".join(channel._decode(span, edges)) == best[1]


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(200_000) < 0.7
    seen = np.array([[0.6, 0.97], [0.5, 0.99], [0.7, 0.95], [0.4, 0.98], [0.8, 0.96]])  # of the bad, of the good
    right = rng.random((len(truth), 5)) < np.where(truth[:, None], seen[:, 1], seen[:, 0])
    votes = np.where(rng.random(right.shape) < 0.8, np.where(right, truth[:, None], ~truth[:, None]).astype(int), -1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, acc, share = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.02 and np.abs(acc - seen).max() < 0.03
    # one step over the counted patterns, written plainly, changes nothing: the result is a fixed point
    for k in range(5):
        for y in (0, 1):
            w = counts * (post if y else 1 - post)
            cast = patterns[:, k] >= 0
            assert abs((w * (cast & (patterns[:, k] == y))).sum() / (w * cast).sum() - acc[k, y]) < 1e-3


def test_pipeline(spark):
    docs = {r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "MinHash near-dedup", "packing"]
    got = corpus_pipeline.run(spark, DIR).collect()
    assert {r.doc_id for r in got} < docs and all(r.length > 0 for r in got)
