import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskgraph.llm.sharding import equal_text_links, op10_label_propagation, place, propagate

from .cases import awkward, empty, write


def check(got, docs):
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 24 and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def loads(got):
    out = Counter({s: 0 for s in range(24)})
    for r in got:
        out[r["shard"]] += r["size"]
    return out.values()


@pytest.mark.parametrize("d", ["sf0.01", "sf0.1"])
def test_whole_table(spark, d):
    path = f"/root/testdata/{d}"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = [r.asDict() for r in op10_label_propagation(spark, path).collect()]
    check(got, docs)
    x = loads(got)
    assert max(x) - min(x) < 0.02 * sum(x) / 24, (min(x), max(x))
    where = defaultdict(set)
    for r in got:
        where[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())  # no group of equal texts is as large as a shard here


def test_awkward_rows(spark, tmp_path):
    rows = awkward(spark)
    check([r.asDict() for r in op10_label_propagation(spark, write(spark, tmp_path, rows)).collect()], [(r.doc_id, r.text) for r in rows.collect()])
    assert op10_label_propagation(spark, write(spark, tmp_path, empty(spark))).count() == 0


def test_a_group_larger_than_its_quota_is_cut_into_few_runs(spark):
    n = 4800
    nodes = spark.range(n).selectExpr("id AS row", "100L AS size")
    links = spark.range(1, n // 3).selectExpr("id AS a", "0L AS b")
    got = {r.row: r.shard for r in place(nodes, links, 24).collect()}
    assert len(got) == n
    assert all(abs(x - 200) <= 2 for x in Counter(got.values()).values())
    assert len({got[i] for i in range(n // 3)}) <= 9  # 8 quotas


@pytest.mark.parametrize("d", ["sf0.01", "sf0.1"])
def test_propagation_moves_the_rows_of_the_query(spark, d):
    rows = spark.read.parquet(f"/root/testdata/{d}/documents.parquet").selectExpr("doc_id AS row", "octet_length(text) + 8L AS size", "xxhash64(text) AS text_hash")
    n, total = rows.agg(F.count("row"), F.sum("size")).first()
    links, trace = equal_text_links(rows, n), []
    cut = lambda at: sum(at[a] != at[b] for a, b in map(tuple, links.collect()))
    start = {r.row: r.s for r in rows.selectExpr("row", "pmod(xxhash64(row), 24) AS s").collect()}
    end = {r.row: r.shard for r in propagate(rows.select("row", "size"), links, 24, total / 24, 6, trace).collect()}
    most = max(Counter(x for pair in links.collect() for x in pair).values())
    assert trace[0][0] > 0 and trace[0][1] > 0 and trace[-1][0] == 0
    assert cut(start) > 0.8 * links.count() and cut(end) == 0 and most <= 2 * (n**0.5 + 1)


def test_links_join_each_group_of_equal_texts(spark):
    rows = spark.range(5000).selectExpr("id AS row", "CASE WHEN id < 3000 THEN 1 ELSE id DIV 2 END AS text_hash")
    root = {r.row: r.row for r in rows.collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in map(tuple, equal_text_links(rows, 5000).collect()):
        a, b = find(a), find(b)
        assert a != b  # trees
        root[max(a, b)] = min(a, b)
    assert all(find(r.row) == (0 if r.row < 3000 else r.row // 2 * 2) for r in rows.collect())


def test_propagation_joins_a_ring_of_neighbours(spark):
    edges = [(10 * c + i, 10 * c + j) for c in range(40) for i in range(10) for j in range(i)]
    nodes = spark.range(400).selectExpr("id AS row", "1L AS size")
    now = propagate(nodes, spark.createDataFrame(edges, "a long, b long"), 4, 400, 4).collect()
    where = defaultdict(set)
    for r in now:
        where[r.row // 10].add(r.shard)
    assert sum(len(x) == 1 for x in where.values()) >= 38
