"""Sinks round trip, the persistent ledger, reports; the queries added with them against their SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from riskgraph.operators import encode, evidence, graph, ledger, metrics, policy
from riskgraph.plans.registry import ORACLE_SQL, QUERIES
from riskgraph.sources import sinks

from .test_operators import DIR, TABLES, rows

NEW = ["slice_device_coverage", "slice_uid_freshness", "psi_report", "train_prior", "feature_pass_through", "case_subgraph_nodes", "noisy_or_top50", "decision_cost",
       "calibration_report", "ledger_lines", "completion_cache"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_ledger_is_appended_read_and_verified(spark, tmp_path):
    path = str(tmp_path / "ledger")
    entries = spark.createDataFrame([(k, f"k{k}", None if k % 2 else "block", 0.25 * k, "not this") for k in range(1, 8)], "seq long, case_id string, action string, score double, prev_hash string")
    sinks.append_ledger(entries.filter("seq <= 4"), path)
    sinks.append_ledger(entries.filter("seq > 4"), path)
    got = sinks.read_ledger(spark, path)
    lines = [json.loads(r.entry) for r in got.orderBy("seq").collect()]
    assert [x["seq"] for x in lines] == list(range(1, 8)) and lines[0]["prev_hash"] == ledger.GENESIS
    assert all(b["prev_hash"] == a["hash"] for a, b in zip(lines[:-1], lines[1:], strict=True))
    assert all(("action" in x) == (x["seq"] % 2 == 0) for x in lines)
    assert tuple(ledger.verify_lines(got).first()) == (7, 0, True)
    assert tuple(ledger.verify_lines(got.withColumn("entry", F.regexp_replace("entry", "k3", "k9"))).first()) == (7, 1, False)
    assert not ledger.verify_lines(got.filter("seq <> 3")).first().valid  # a gap
    assert tuple(ledger.verify_lines(got.filter("seq < 0")).first()) == (0, 0, True)
    with pytest.raises(ValueError, match="rise"):
        sinks.append_ledger(entries.filter("seq = 7"), path)
    (tmp_path / "ledger.lock").touch()
    with pytest.raises(RuntimeError, match="lock"):
        sinks.append_ledger(entries.filter("seq = 7"), path)


def test_features_queue_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, None)], "txn_id long, amt double, kind string")
    sinks.write_features(df, str(tmp_path), prior=0.25)
    back, meta = sinks.read_features(spark, str(tmp_path))
    assert sorted(back.collect()) == sorted(df.collect()) and meta["categorical"] == ["kind"] and meta["prior"] == 0.25
    queue = str(tmp_path / "queue")
    assert sinks.read_queue(spark, queue, df.schema, fallback=df).count() == 2
    sinks.write_queue(df, queue)
    assert sinks.case(sinks.read_queue(spark, queue, df.schema), 1, "txn_id").first().amt == 2.5
    sinks.write_reports(str(tmp_path), {"rates": ("Rates", df)})
    assert (tmp_path / "rates.md").read_text().splitlines()[-1] == "| 2 |  |  |"


def test_small_operators(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0, 2.0, "block"), ("b", 1.0, 3.0, 2.0, "other")], "comp string, cost_allow double, cost_block double, cost_review double, d string")
    assert [r.c for r in df.orderBy("comp").select(policy.cost_of(F.col("d")).alias("c")).collect()] == [3.0, None]
    assert encode.categorical_columns(df, ("d",)) == ["comp"]
    said = spark.createDataFrame([("yes",), ("<think>no</think> yes, it is",), ("partial",), ("hm",)], "reply string")
    assert tuple(evidence.support(said).first()) == (4, 2, 0.5)
    assert tuple(evidence.support(said.limit(0)).first()) == (0, 0, None)
    two = spark.createDataFrame([(float(k % 40), float(k + 500 * (k % 2)), k % 2) for k in range(800)], "same double, moved double, side int")
    assert [(r.feature, r.flagged) for r in metrics.psi_report(two, ["same", "moved"], "side").collect()][0] == ("moved", True)


def test_smallest_reachable_over_many_blocks(spark):
    """Chains, stars and loops whose ids lie in blocks of their own, so that the steps between tasks do the joining."""
    links = [(1, a, b) for a, b in zip(range(40, 0, -1), range(39, -1, -1), strict=True)] + [(1, 100, k) for k in range(101, 120)]
    links += [(2, 7 * k % 61, 7 * (k + 3) % 61) for k in range(30)] + [(2, 80, 81), (2, 81, 82), (2, 82, 80), (2, 90, 90), (3, 5, -4), (3, 5, -4)]
    group = {}
    for d, a, b in links:
        a, b = group.get((d, a), {(d, a)}), group.get((d, b), {(d, b)})
        for x in (both := a | b):
            group[x] = both
    big = 1 << 21
    df = spark.createDataFrame([(d, a * big, b * big) for d, a, b in links], "d long, u long, v long").repartition(7)
    got = {(r.d, r.u // big): r.v // big for r in graph.smallest_reachable(df).collect()}
    assert got == {x: min(g)[1] for x, g in group.items() if min(g) != x}
    assert graph.smallest_reachable(df.limit(0)).count() == 0
