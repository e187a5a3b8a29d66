import random
from collections import Counter

import numpy as np
import pyarrow as pa

from riskgraph.llm.bagminhash import _bags, classes, keep_one, odd_sketches, op5_bagminhash, shingles, signatures, similarity
from riskgraph.llm.common import large_binary_column

from .cases import awkward, empty, write


def bag(text):
    w = (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    w = [x for x in w if x]
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    low = sum((a & b).values())
    high = sum((a | b).values())
    return low / high if high else 1.0


def brute(docs):
    """doc_id -> smallest id of its class, over all pairs that share a shingle."""
    bags = {}
    for i, t in docs:
        bags.setdefault(t or "", []).append(i)
    texts = [(bag(t), min(ids), ids) for t, ids in bags.items()]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    index = {}
    for k, (b, _, _) in enumerate(texts):
        near = set()
        for s in b:
            near.update(index.setdefault(s, []))
            index[s].append(k)
        for j in near:
            if jaccard(b, texts[j][0]) >= 0.8:
                x, y = find(j), find(k)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (_, m, _) in enumerate(texts):
        least[find(k)] = min(least.get(find(k), m), m)
    return {i: least[find(k)] for k, (_, _, ids) in enumerate(texts) for i in ids}


def test_bags_and_similarity():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", "one two", "x " * 300]
    b = pa.record_batch({"key": pa.array([b"k"] * len(texts)), "text": texts})
    got = [x for part in _bags(iter([b])) for x in part.column("bag").to_pylist()]
    for i in range(0, len(texts), 3):
        for j in range(len(texts)):
            assert abs(similarity(got[i], got[j]) - jaccard(bag(texts[i]), bag(texts[j]))) < 1e-12


def test_signatures_are_unbiased():
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") for _ in range(3)] * 20 + [str(rng.random()) for _ in range(200)]
    other = base[:40] + [str(rng.random()) for _ in range(30)] + base[70:]
    texts = [" ".join(base), " ".join(other)]
    doc, x, n = shingles(*large_binary_column(pa.record_batch({"text": texts}), "text"))
    sig = signatures(doc, x, n, 2, 20_000)
    assert abs((sig[0] == sig[1]).mean() - jaccard(bag(texts[0]), bag(texts[1]))) < 0.015


def test_odd_sketches_differ_in_no_more_bits_than_the_bags():
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") for _ in range(400)]
    texts = [" ".join(base[:k] + [str(rng.random()) for _ in range(k // 8)] + base[k:]) for k in range(0, 400, 25)] + [""]
    doc, x, n = shingles(*large_binary_column(pa.record_batch({"text": texts}), "text"))
    got = np.unpackbits(odd_sketches(doc, x, n, len(texts)).view(np.uint8), axis=1)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            apart = sum(((bag(a) - bag(b)) + (bag(b) - bag(a))).values())
            assert (got[i] != got[j]).sum() <= apart


def test_whole_table_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in op5_bagminhash(spark, d).collect()}
    assert got == brute(docs)


def test_chains_stars_and_awkward_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(words, 200))
    rows, cur = [], base
    for i in range(12):  # a chain: each near the next, the ends far apart
        rows.append((i, " ".join(cur)))
        cur = cur[8:] + list(rng.choice(words, 8))
    rows += [(100 + i, " ".join([*rng.choice(words, 60), *base[:60], *rng.choice(words, 60)])) for i in range(30)]  # a shared passage
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in classes(df).collect()} == brute(rows)
    odd = awkward(spark)
    assert op5_bagminhash(spark, write(spark, tmp_path, odd)).count() == odd.count()
    assert op5_bagminhash(spark, write(spark, tmp_path, empty(spark))).count() == 0
    kept = [r.doc_id for r in keep_one(odd).collect()]
    assert sorted(kept, key=str) == [0, 2, 3, 4, 6, 7, 8, 9, None] and keep_one(odd).columns == odd.columns
