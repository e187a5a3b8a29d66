"""Operators against brute force and hand-made values; every registered query against its SQL."""

import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskgraph.config import Config
from riskgraph.functions.scalars import noisy_or, norm_token, numbers_in
from riskgraph.operators import causal, encode, entities, evidence, graph, ledger, metrics, policy, split
from riskgraph.plans.registry import ORACLE_SQL, PAIR, PRIOR, QUERIES
from riskgraph.sources import tables
from riskgraph.streaming.velocity import event_stream, velocity

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: One of each family here; the driver compares all of them.
SOME = ["causal_prior_count_amt", "causal_velocity", "causal_label_lag_rate", "split_boundaries", "entity_report", "ring_distinct_entities", "graph_stats",
        "rules_baseline", "pr_auc", "ece_bins", "slice_amount_band", "psi_drift", "policy_argmin", "ledger_chain", "session_bursts"]


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


def test_strictly_prior_with_ties_and_a_negative(spark):
    data = [(1, 10, 1.0, 1, "a"), (2, 10, 2.0, 0, "a"), (3, 20, 4.0, None, "a"), (4, 20, 8.0, 1, None), (5, 90, 16.0, 1, "a")]
    df = spark.createDataFrame(data, "txn_id long, dt long, amt double, label long, uid string")
    out = causal.entity_features(df, "uid", "uid", 0.2, Config(velocity_windows=(15, 3600)), lag_seconds=60)
    got = {r.txn_id: r for r in out.collect()}
    for t, dt, _, _, key in data:
        prior = [x for x in data if key and x[4] == key and x[1] < dt]
        mature = [x for x in prior if x[1] + 60 <= dt and x[3] is not None]
        assert got[t].uid_prior_count == len(prior)
        assert got[t].uid_velocity_15s == sum(x[1] >= dt - 15 for x in prior)
        assert got[t].uid_prior_n_labeled == len(mature)
        assert math.isclose(got[t].uid_prior_amt_mean, sum(x[2] for x in prior) / len(prior) if prior else -1)
    causal.assert_causal(out, 60)
    with pytest.raises(AssertionError):
        causal.assert_causal(out.withColumn("uid_max_contrib_dt", F.col("dt")), 60)
    with pytest.raises(ValueError):
        causal.violations(causal.drop_proofs(out), 60)


def test_components_equal_the_capped_kernel_without_a_cap(spark):
    cfg = Config(component_fraction=1.0, component_cap=10**9)
    members = graph.window_members(tables.transactions(spark, DIR), cfg)
    a = {(r.d, r.txn_id): r.comp for r in graph.components(members, cfg, PAIR)[0].collect()}
    b = {(r.d, r.txn_id): r.comp for r in graph.capped_components(members, cfg, PAIR).collect()}
    assert a.keys() == b.keys()
    assert len({(k[0], a[k], b[k]) for k in a}) == len({(k[0], v) for k, v in a.items()}) == len({(k[0], v) for k, v in b.items()})
    capped = graph.capped_components(members, Config(component_cap=3), PAIR).groupBy("d", "comp").count()
    assert capped.agg(F.max("count")).first()[0] <= 3


def test_components_of_very_large_ids(spark):
    top = 1 << 62
    members = spark.range(8).select(F.lit(1).cast("long").alias("d"), (F.lit(top) + F.col("id")).alias("txn_id"), (F.col("id") / 2).cast("int").cast("string").alias("device"), F.lit(None).cast("string").alias("card"))
    comp, _ = graph.components(members, Config(), PAIR)
    assert sorted((r.txn_id - top, r.comp - top) for r in comp.collect()) == [(k, k - k % 2) for k in range(8)]


def test_metrics_by_hand(spark):
    cols = "txn_id long, label long, score double, day long, dt long"
    # thresholds .8 (1 of 1), .6 (tied: 2 of 3), .4 (2 of 4), .2 (3 of 5): precision after each gain in recall
    df = spark.createDataFrame([(11, 1, 0.8, 2, 5), (12, 0, 0.6, 2, 6), (13, 1, 0.6, 3, 7), (14, 0, 0.4, 3, 8), (15, 1, 0.2, 3, 9)], cols)
    assert math.isclose(metrics.pr_auc(df).first()[0], (1 + 2 / 3 + 3 / 5) / 3, abs_tol=1e-6)
    assert math.isclose(metrics.roc_auc(df).first()[0], (2 + 1.5 + 0) / 6, abs_tol=1e-6)
    assert metrics.precision_at_k(df, 1).first()[0] == 1.0  # 11 on day 2, 13 on day 3
    assert math.isclose(metrics.precision_at_k(df, 2).first()[0], 0.5)
    c = spark.createDataFrame([(True, 1), (True, 0), (False, 1)], "flagged boolean, n_fraud long")
    assert metrics.case_precision(c).first()[0] == 0.5
    same = spark.range(1000).select((F.col("id") % 2).cast("int").alias("side"), F.floor(F.col("id") / 2).cast("double").alias("x"))
    assert metrics.psi(same, ["x"], "side").first().psi < 0.01
    assert metrics.psi(same.withColumn("x", F.col("x") + F.col("side") * 600), ["x"], "side").first().psi > 0.25


def test_policy_and_noisy_or(spark):
    df = spark.createDataFrame([(1, 0.9, 10_000.0, 0), (2, 0.1, 10_000.0, 0)], "comp long, score double, amount_inr double, day long")
    got = {r.comp: r for r in policy.expected_costs(df, policy.Costs()).collect()}
    assert got[1].cost_allow > got[1].cost_block and got[2].cost_block > got[2].cost_allow
    p = spark.createDataFrame([(0.5,), (0.5,)], "p double")
    assert math.isclose(p.agg(noisy_or(F.col("p"))).first()[0], 0.75)
    assert p.withColumn("p", F.lit(1.0)).agg(noisy_or(F.col("p"))).first()[0] == 1.0
    with pytest.raises(ValueError):
        policy.check_decision("maybe")


def test_ledger_finds_tampering_and_a_cut_tail(spark):
    df = spark.createDataFrame([(i, f"c{i}", None if i % 2 else "block") for i in range(9)], "seq long, case_id string, action string")
    chain = ledger.build(df, ["case_id", "action"])
    check = lambda x, **k: ledger.verify(x, ["case_id", "action"], **k).first().valid
    assert check(chain) and check(chain.limit(0))
    assert not check(chain.withColumn("action", F.lit("allow")))
    assert not check(chain.filter("seq <> 4"))
    assert check(chain.filter("seq < 8")) and not check(chain.filter("seq < 8"), expected_count=9)


def test_texts_and_evidence(spark):
    df = spark.createDataFrame([("Chrome 63.0  x",), ("1920x1080",), (None,), ("12.5",)], "t string")
    assert [r[0] for r in df.select(norm_token(F.col("t"))).collect()] == ["chrome x", "x", "NA", "NA"]
    said = spark.createDataFrame([("ring_88 holds 5 rows worth 2,310.75, model v9, shift -4",)], "t string").select(numbers_in(F.col("t"))).first()[0]
    assert said == [5.0, 2310.75, -4.0]
    verdict = spark.createDataFrame([("<think>no</think> Yes, it is",), ("<think>cut",), ("no.",)], "t string")
    assert [r[0] for r in verdict.select(evidence.parse_verdict(F.col("t"))).collect()] == ["yes", "unparsed", "no"]
    b = QUERIES["numeric_fidelity"](spark, DIR)
    assert b.filter("fidelity < 1").count() == 0


def test_card_keys(spark):
    cols = "card1 double, card2 double, card3 double, card5 double, addr1 double, addr2 double, D1 double, day long, DeviceInfo string, id_30 string, id_31 string, id_32 double, id_33 string, P_emaildomain string"
    df = spark.createDataFrame([(1.0, None, 150.0, 226.0, 2.0, 87.0, 3.0, 10, "SM-G9 Build", None, "chrome 63.0", 32.0, None, "Gmail.com"), (None, None, None, None, None, None, None, 1, None, None, None, None, None, None)], cols)
    a, b = entities.card_keys(df).collect()
    assert (a.uid, a.uid_min, a.device, a.email, a.addr, a.card) == ("1_NA_150_226_2_87_7", "1_2_7", "sm-g build|NA|chrome|32|NA", "gmail.com", "2_87", "1_NA")
    assert (b.uid, b.device, b.email, b.addr, b.card) == (None,) * 5


def test_split_sources_and_pruning(spark, tmp_path):
    s = split.temporal_split(tables.transactions(spark, DIR), Config())
    split.assert_ordered(s)
    with pytest.raises(ValueError):
        split.temporal_split(s.select("txn_id", "day", "label", F.lit(-1).alias("dt")), Config())
    shuffled = split.shuffled_labels(tables.transactions(spark, DIR), 7)
    assert shuffled.agg(F.sum("label")).first()[0] == s.agg(F.sum("label")).first()[0]
    with pytest.raises(ValueError):
        Config(lookback_days=3, label_lag_days=3)
    x = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.sin("id").alias("c"))
    assert encode.correlation_prune(x, ["a", "b", "c"]) == ["a", "c"]
    for name, text in (("t.csv", "txn_id,amt\n1,2.5\n2,3.5\n"), ("i.csv", "txn_id,id-01\n2,x\n")):
        (tmp_path / name).write_text(text)
    raw = tables.load_raw(spark, str(tmp_path / "t.csv"), str(tmp_path / "i.csv"), "txn_id long, amt double", "txn_id long, `id-01` string")
    assert sorted(map(tuple, raw.collect())) == [(1, 2.5, None), (2, 3.5, "x")]
    assert len(tables.checksums(spark, str(tmp_path)).first().sha256) == 64
    with pytest.raises(FileNotFoundError):
        tables.require(spark, str(tmp_path / "none"))
    assert tables.markdown_table(raw.orderBy("txn_id")).endswith("| 1 | 2.5000 |  |\n| 2 | 3.5000 | x |")
    assert PRIOR == 0.2


def test_correlation_matrix_equals_its_sql(spark, tmp_path):
    """As it is; and with a column that doesn't vary, one without values and one with a few."""
    odd = f"SELECT * REPLACE (0.04::DOUBLE AS l_discount, NULL::DOUBLE AS l_tax, CASE WHEN l_linenumber = 2 THEN l_quantity END AS l_quantity) FROM '{DIR}/lineitem.parquet'"
    duckdb.connect().execute(f"COPY ({odd}) TO '{tmp_path}/lineitem.parquet'")
    for d in (DIR, str(tmp_path)):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet'")
        got, want = sorted(map(tuple, QUERIES["correlation_matrix"](spark, d).collect())), sorted(con.execute(ORACLE_SQL["correlation_matrix"]).fetchall())
        assert len(got) == 10 and str(got) == str(want)  # nan is null in pandas and not equal to itself


def test_correlation_prune(spark):
    """The query keeps what its matrix says; a column that doesn't vary correlates with none."""
    kept = {r.kept for r in QUERIES["correlation_prune"](spark, DIR).collect()}
    high = {(r.a, r.b) for r in QUERIES["correlation_matrix"](spark, DIR).collect() if r.r > 0.95}
    assert high == {("l_extendedprice", "gross")} and kept == {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}
    x = spark.range(50).select(F.lit(0.04).alias("a"), F.col("id").cast("double").alias("b"), (F.col("id") * 2.0).alias("c"), F.lit(None).cast("double").alias("d"))
    assert encode.correlation_prune(x, ["a", "b", "c", "d"]) == ["a", "b", "d"]


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{DIR}/events.parquet")
    ev.write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in ev.dtypes)
    q = velocity(event_stream(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("v").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("v").collect())) == sorted(map(tuple, velocity(ev).collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
    assert os.path.basename(DIR) == "sf0.001"
