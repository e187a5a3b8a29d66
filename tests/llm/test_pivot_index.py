import numpy as np
import pytest

from riskgraph.llm.pivot_index import near_duplicates, op3_pivot_index

SCHEMA = "vec_id long, embedding array<float>, label int, row string, pivot string, n_links int"


def brute(rows):
    """vec_id -> (n_links, component, kept) and the number of links."""
    fine = {}
    for k, (i, v, label) in enumerate(rows):
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        fine[k] = np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok else None
    root = list(range(len(rows)))
    n = [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    groups = {}
    for k, (_, v, label) in enumerate(rows):
        if fine[k] is not None:
            groups.setdefault((label, len(v)), []).append(k)
    for own in groups.values():
        c = np.array([fine[k] for k in own])
        for a, b in zip(*np.nonzero(np.triu(c @ c.T >= 0.93, 1)), strict=True):
            n[own[a]] += 1
            n[own[b]] += 1
            x, y = find(own[a]), find(own[b])
            root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, n[k], least[find(k)], i == least[find(k)]) for k, (i, _, _) in enumerate(rows)), sum(n) / 2


@pytest.mark.parametrize("d", ["sf0.01", "sf0.1"])
def test_whole_table_against_brute_force(spark, d):
    path = f"/root/testdata/{d}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, total = brute(rows)
    got = sorted(map(tuple, op3_pivot_index(spark, path).collect()))
    assert sum(x[1] for x in got) / 2 >= 0.9 * total
    assert got == want


def test_awkward_vectors(spark):
    e = [float(x == 3) for x in range(8)]
    nan = [float("nan"), *e[1:]]
    rows = [(1, e, 0), (2, e, 0), (2, e, 0), (3, [2 * x for x in e], 0), (4, e, 1), (5, e, None), (6, None, 0), (7, [], 0), (8, [0.0] * 8, 0), (9, nan, 0),
            (10, [float("inf"), *e[1:]], 0), (11, [None, *e[1:]], 0), (12, e[:4], 0), (13, [1e30 * x for x in e], 0), (14, [1e-30 * x for x in e], 0)]
    df = spark.createDataFrame([(*r, "x", "y", 5) for r in rows], SCHEMA)
    got = sorted(map(tuple, near_duplicates(df, block=2).collect()))
    assert got == brute(rows)[0]
    assert near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in near_duplicates(spark.createDataFrame([(None, e, 0, "", "", 0)], SCHEMA)).collect()] == [(None, 0, None, True)]


def test_recall_on_planted_pairs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for label in range(4):
        x = rng.normal(size=(2500, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        c = rng.uniform(0.931, 0.99, (2500, 1))
        rows += [(len(rows) + k, v.tolist(), label) for k, v in enumerate(np.concatenate([x, c * x + (1 - c**2) ** 0.5 * z]))]
    centre = rng.normal(size=64)  # a cluster far larger than a block
    rows += [(len(rows) + k, (centre + rng.normal(size=64) * 0.1).tolist(), 0) for k in range(900)]
    rows += [(len(rows) + k, centre.tolist(), 0) for k in range(300)]
    want, total = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in near_duplicates(df, block=64).collect()}
    assert total > 10_000 + 1200 * 1199 / 2 - 1 and all(got[i] <= n for i, n, _, _ in want)
    pairs = [(got[i], n) for i, n, _, _ in want if i < 20_000]
    assert sum(g for g, _ in pairs) >= 0.9 * sum(n for _, n in pairs) > 0
    big = [(got[i], n) for i, n, _, _ in want if i >= 20_000]
    assert sum(g for g, _ in big) >= 0.9 * sum(n for _, n in big)
    print("recall", sum(g for g, _ in pairs) / sum(n for _, n in pairs), sum(g for g, _ in big) / sum(n for _, n in big))
