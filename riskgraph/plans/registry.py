"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, Costs
from ..functions.scalars import id_string, norm_token
from ..operators import causal, encode, entities, evidence, graph, ledger, metrics, policy, ring, rules, scoring, split
from ..sources.tables import coverage, read, summary, transactions
from ..streaming.velocity import bursts, velocity

CFG, COSTS = Config(), Costs()
PAIR = ["device", "card"]
PRIOR, LAG = 0.2, CFG.label_lag_days * 86400
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_X = """x0 AS (SELECT event_id AS txn_id, epoch_us(ts) // 1000000 - 1704067200 AS dt, value AS amt, (event_type = 'error')::BIGINT AS label, event_type,
  user_id, c_nationkey AS nation, c_mktsegment AS segment, json_extract_string(props, '$.k') AS k FROM events JOIN customer ON user_id = c_custkey),
x1 AS (SELECT *, dt // 86400 AS day, (dt // 3600) % 24 AS hour, (dt // 86400) % 7 AS day_of_week FROM x0),
x AS (SELECT *, user_id || '_' || nation AS uid, k || '|' || hour AS device, user_id || '_' || k AS card, nation || '_' || segment AS addr, segment AS email FROM x1)"""
_SCORE = "round((txn_id * 7919 % 1000) / 1000.0 * 0.7 + label * 0.3, 6)"
_S = _X + f", s AS (SELECT txn_id, dt, day, hour, amt, label, {_SCORE} AS score FROM x)"
_N = _X + """, n0 AS (SELECT *, row_number() OVER (ORDER BY dt, txn_id) - 1 AS pos, count(*) OVER () AS n FROM x),
edge AS (SELECT min(dt) FILTER (pos = round_even(n * 0.6, 0)) AS b1, min(dt) FILTER (pos = round_even(n * 0.8, 0)) AS b2, round_even(max(n) * 0.6, 0) AS i1, round_even(max(n) * 0.8, 0) AS i2 FROM n0),
sp AS (SELECT n0.* EXCLUDE (n), CASE WHEN pos < i1 THEN 'train' WHEN pos < i2 AND dt < b1 + 86400 THEN 'embargo' WHEN pos < i2 THEN 'val' WHEN dt < b2 + 86400 THEN 'embargo' ELSE 'test' END AS split FROM n0, edge)"""
_UID = "PARTITION BY uid ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND"
_CC = _X + f""", days AS (SELECT DISTINCT day AS d FROM x), mem AS (SELECT days.d, x.* FROM days JOIN x ON x.day >= d - {CFG.lookback_days} AND x.day < d),
long AS (SELECT d, txn_id, 'device' AS etype, device AS value FROM mem UNION ALL SELECT d, txn_id, 'card', card FROM mem),
dg AS (SELECT d, etype, value, count(*) AS degree FROM long WHERE value IS NOT NULL GROUP BY ALL),
kept AS (SELECT long.* FROM long JOIN dg USING (d, etype, value) WHERE degree BETWEEN {CFG.min_degree} AND {CFG.max_degree}),
e AS (SELECT DISTINCT a.d, a.txn_id AS p, b.txn_id AS q FROM kept a JOIN kept b USING (d, etype, value)),
cc(d, n, l) USING KEY (d, n) AS (SELECT d, p, min(q) FROM e GROUP BY d, p UNION
  SELECT e.d, e.p, min(cc.l) FROM e JOIN cc ON e.d = cc.d AND e.q = cc.n JOIN recurring.cc AS r ON r.d = e.d AND r.n = e.p WHERE cc.l < r.l GROUP BY e.d, e.p),
comp AS (SELECT mem.d, mem.txn_id, coalesce(cc.l, mem.txn_id) AS comp FROM mem LEFT JOIN cc ON cc.d = mem.d AND cc.n = mem.txn_id),
vc AS (SELECT k.d, etype, value, min(comp) AS comp FROM kept k JOIN comp USING (d, txn_id) GROUP BY ALL),
att AS (SELECT x.day AS d, x.txn_id, coalesce(v.comp, c.comp) AS comp FROM x LEFT JOIN vc v ON v.d = x.day AND v.etype = 'device' AND v.value = x.device
  LEFT JOIN vc c ON c.d = x.day AND c.etype = 'card' AND c.value = x.card WHERE coalesce(v.comp, c.comp) IS NOT NULL),
rr AS (SELECT comp.d, comp, 'window' AS role, x.* FROM comp JOIN x USING (txn_id) UNION ALL SELECT att.d, comp, 'today', x.* FROM att JOIN x USING (txn_id)),
fl AS (SELECT *, dt - lag(dt) OVER (PARTITION BY d, comp ORDER BY dt, txn_id) AS gap,
  {', '.join(f"(row_number() OVER (PARTITION BY d, comp, {t} ORDER BY dt, txn_id) = 1)::BIGINT AS f_{t}" for t in ('uid', 'device', 'addr', 'card'))} FROM rr)"""
_P = "PARTITION BY d, comp ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_CASES = _X + f""", c0 AS (SELECT x.*, user_id AS comp, {_SCORE} AS score FROM x), m0 AS (SELECT *, max(dt) OVER (PARTITION BY comp) - dt <= 86400 AS recent FROM c0),
roll AS (SELECT comp, count(*) AS n_transactions, sum(amt) AS amount, count(DISTINCT uid) AS n_uid, count(DISTINCT device) AS n_device,
  CASE WHEN avg(amt) > 0 THEN sqrt(greatest(avg(amt * amt) - avg(amt) * avg(amt), 0.0)) / avg(amt) ELSE -1.0 END AS amount_cv, (max(dt) - min(dt)) / 3600.0 AS age_hours,
  sum(recent::INT)::BIGINT AS velocity_24h, min(day) AS day_start, max(day) AS day_end, sum(label)::BIGINT AS n_fraud, sum(amt) * {CFG.usd_inr} AS amount_inr FROM m0 GROUP BY comp HAVING count(*) >= 2),
top AS (SELECT comp, score AS p, row_number() OVER (PARTITION BY comp ORDER BY score DESC, txn_id) AS rank FROM c0),
sc AS (SELECT comp, CASE WHEN max(p) >= 1 THEN 1.0 ELSE 1 - exp(sum(ln(1 - p))) END AS score FROM top WHERE rank <= 3 GROUP BY comp),
ec AS (SELECT *, score * (amount_inr + {COSTS.chargeback_fee}) AS cost_allow, (1 - score) * (amount_inr * {COSTS.false_block} + {COSTS.block_friction}) AS cost_block,
  {COSTS.review} + (1 - {COSTS.review_recall}) * score * (amount_inr + {COSTS.chargeback_fee}) AS cost_review FROM roll JOIN sc USING (comp)),
dc AS (SELECT *, CASE WHEN cost_allow <= cost_block AND cost_allow <= cost_review THEN 'allow' WHEN cost_block <= cost_review THEN 'block' ELSE 'review' END AS decision,
  least(cost_allow, cost_block, cost_review) AS expected_cost, cost_allow - least(cost_allow, cost_block, cost_review) AS expected_saving FROM ec)"""


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_TIES = {"uid_prior_amt_mean": 1e-10, "comp_amt_mean": 1e-10}  # means of cents lie on ties of the sixth place


def _r(*cols: str, places: int = 6) -> list:
    return [F.round(F.col(c) + _TIES.get(c, 0.0), places).alias(c) for c in cols]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    score = F.round(F.col("txn_id") * 7919 % 1000 / 1000.0 * 0.7 + F.col("label") * 0.3, 6)
    return tx.withColumn("score", score)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as cases of the deterministic score, with costs."""
    tx = _scored(spark, sf_dir).withColumn("comp", F.col("user_id"))
    out = policy.case_rollup(tx, CFG).join(policy.case_scores(tx, 3), "comp")
    return policy.expected_costs(out, COSTS)


def _ring(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, _ = graph.ring_rows(transactions(spark, sf_dir), CFG, PAIR)
    return rows, ring.ring_features(rows, PRIOR, CFG)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["causal_prior_count_amt"](spark, sf_dir)


# sources and scalars

@query("prepare_time_parts", f"WITH {_X} SELECT txn_id, dt, day, hour, day_of_week FROM x")
def _(spark, d):
    return transactions(spark, d).select("txn_id", "dt", "day", "hour", "day_of_week")


@query("dataset_summary", f"WITH {_X} SELECT count(*) AS rows, sum(label)::BIGINT AS positives, round(avg(label), 6) AS base_rate, min(day) AS min_day, max(day) AS max_day, min(dt) AS min_dt, max(dt) AS max_dt FROM x")
def _(spark, d):
    return summary(transactions(spark, d))


_COVER = ["txn_id", "amt", "uid", "device", "card", "addr", "email", "k"]


@query("coverage_profile", f"WITH {_X} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS present, round(count({c}) * 100.0 / count(*), 2) AS coverage_pct, count(DISTINCT {c}) AS n_distinct FROM x" for c in _COVER))
def _(spark, d):
    return coverage(transactions(spark, d), _COVER).withColumn("coverage_pct", F.col("coverage_pct").cast("double"))


@query("identity_join", "SELECT o_orderkey AS txn_id, c_name, c_nationkey::BIGINT AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(spark, d):
    c = read(spark, d, "customer").filter("c_acctbal > 0")
    o = read(spark, d, "orders")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(F.col("o_orderkey").alias("txn_id"), "c_name", F.col("c_nationkey").cast("bigint").alias("nation"))


_NORM = "coalesce(nullif(trim(regexp_replace(regexp_replace(lower({0}), '\\d+(?:[._]\\d+)*', '', 'g'), '\\s+', ' ', 'g')), ''), 'NA')"


@query("norm_token_strings", f"SELECT c_custkey, {_NORM.format('c_name')} AS name, {_NORM.format('c_mktsegment')} AS segment FROM customer")
def _(spark, d):
    return read(spark, d, "customer").select("c_custkey", norm_token(F.col("c_name")).alias("name"), norm_token(F.col("c_mktsegment")).alias("segment"))


@query("id_strings", "SELECT p_partkey, coalesce(round_even(p_retailprice, 0)::BIGINT::VARCHAR, 'NA') AS price_id FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", id_string(F.col("p_retailprice")).alias("price_id"))


@query("entity_keys", f"WITH {_X} SELECT txn_id, uid, device, email, addr, card FROM x")
def _(spark, d):
    return transactions(spark, d).select("txn_id", *entities.TYPES)


_LONG = " UNION ALL ".join(f"SELECT '{t}' AS etype, {t} AS value FROM x" for t in entities.TYPES)
_DEG = f"WITH {_X}, long AS ({_LONG}), dg AS (SELECT etype, value, count(*) AS degree FROM long WHERE value IS NOT NULL GROUP BY ALL)"


@query("entity_degrees", f"{_DEG} SELECT etype, value, degree FROM dg")
def _(spark, d):
    return entities.degrees(transactions(spark, d))


_REPORT = f"""{_DEG}, n AS (SELECT count(*) AS rows FROM x) SELECT etype, round(sum(degree) * 100.0 / max(rows), 4) AS coverage_pct, count(*) AS n_distinct, round(quantile_cont(degree, 0.5), 6) AS median_degree,
 round(quantile_cont(degree, 0.99), 6) AS p99_degree, max(degree) AS max_degree, count(*) FILTER (degree > {CFG.max_degree}) AS n_values_over_cap,
 coalesce(sum(degree) FILTER (degree > {CFG.max_degree} OR degree < {CFG.min_degree}), 0)::BIGINT AS rows_losing, round(coalesce(sum(degree) FILTER (degree > {CFG.max_degree} OR degree < {CFG.min_degree}), 0) * 100.0 / max(rows), 4) AS losing_pct FROM dg, n GROUP BY etype"""


@query("entity_report", f"SELECT etype, coverage_pct, n_distinct, median_degree, p99_degree, max_degree FROM ({_REPORT})")
def _(spark, d):
    return entities.report(transactions(spark, d), CFG).select("etype", F.col("coverage_pct").cast("double").alias("coverage_pct"), "n_distinct", "median_degree", "p99_degree", "max_degree")


@query("pruning_report", f"SELECT etype, n_values_over_cap, rows_losing, losing_pct FROM ({_REPORT})")
def _(spark, d):
    return entities.report(transactions(spark, d), CFG).select("etype", "n_values_over_cap", "rows_losing", F.col("losing_pct").cast("double").alias("losing_pct"))


# splits

@query("temporal_split_labels", f"WITH {_N} SELECT txn_id, pos, split FROM sp")
def _(spark, d):
    return split.temporal_split(transactions(spark, d), CFG).select("txn_id", "pos", "split")


@query("split_boundaries", f"WITH {_N} SELECT split, count(*) AS n, min(dt) AS min_dt, max(dt) AS max_dt, sum(label)::BIGINT AS positives FROM sp GROUP BY split")
def _(spark, d):
    return split.boundaries(split.temporal_split(transactions(spark, d), CFG))


@query("split_disjoint", f"WITH {_N} SELECT count(*) AS n_shared FROM sp a WHERE split = 'train' AND txn_id IN (SELECT txn_id FROM sp WHERE split <> 'train')")
def _(spark, d):
    s = split.temporal_split(transactions(spark, d), CFG).select("txn_id", "split")
    return s.filter("split = 'train'").join(s.filter("split <> 'train'"), "txn_id", "left_semi").agg(F.count(F.lit(1)).alias("n_shared"))


@query("label_shuffle_control")
def _(spark, d):
    return split.shuffled_labels(transactions(spark, d), 7).select("txn_id", "label")


# strictly-prior aggregates

def _entity(spark, d):
    return causal.entity_features(transactions(spark, d), "uid", "uid", PRIOR, CFG)


@query("causal_prior_count_amt", f"""WITH {_X} SELECT txn_id, count(*) OVER p AS uid_prior_count, round(coalesce(avg(amt) OVER p, -1) + 1e-10, 6) AS uid_prior_amt_mean,
 round(CASE WHEN count(*) OVER p >= 2 AND sum(amt) OVER p > 0 THEN sqrt(greatest(sum(amt * amt) OVER p / count(*) OVER p - (sum(amt) OVER p / count(*) OVER p) ^ 2, 0)) / (sum(amt) OVER p / count(*) OVER p) ELSE -1 END, 6) AS uid_prior_amt_cv,
 round(coalesce((dt - min(dt) OVER p) / 3600.0, -1), 6) AS uid_age_hours FROM x WINDOW p AS ({_UID} 1 PRECEDING)""")
def _(spark, d):
    return _entity(spark, d).select("txn_id", "uid_prior_count", *_r("uid_prior_amt_mean", "uid_prior_amt_cv", "uid_age_hours"))


@query("causal_velocity", f"""WITH {_X} SELECT txn_id, count(*) OVER (PARTITION BY uid ORDER BY dt RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS uid_velocity_1h,
 count(*) OVER (PARTITION BY uid ORDER BY dt RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS uid_velocity_24h FROM x""")
def _(spark, d):
    return _entity(spark, d).select("txn_id", "uid_velocity_1h", "uid_velocity_24h")


@query("causal_label_lag_rate", f"""WITH {_X} SELECT txn_id, count(label) OVER m AS uid_prior_n_labeled, round((coalesce(sum(label) OVER m, 0) + {CFG.smoothing} * {PRIOR}) / (count(label) OVER m + {CFG.smoothing}), 6) AS uid_prior_fraud_rate
 FROM x WINDOW m AS ({_UID} {LAG} PRECEDING)""")
def _(spark, d):
    return _entity(spark, d).select("txn_id", "uid_prior_n_labeled", *_r("uid_prior_fraud_rate"))


@query("causal_proof_columns", f"WITH {_X} SELECT txn_id, coalesce(max(dt) OVER ({_UID} 1 PRECEDING), -1) AS uid_max_contrib_dt, coalesce(max(dt) OVER ({_UID} {LAG} PRECEDING), -1) AS uid_label_max_contrib_dt FROM x")
def _(spark, d):
    return _entity(spark, d).select("txn_id", "uid_max_contrib_dt", "uid_label_max_contrib_dt")


@query("causality_violations", "SELECT 0::BIGINT AS not_prior, 0::BIGINT AS not_mature")
def _(spark, d):
    return causal.violations(_entity(spark, d), LAG)


# graphs

@query("component_window_members", f"WITH {_X}, days AS (SELECT DISTINCT day AS d FROM x) SELECT d, txn_id FROM days JOIN x ON day >= d - {CFG.lookback_days} AND day < d")
def _(spark, d):
    return graph.window_members(transactions(spark, d), CFG).select("d", "txn_id")


@query("window_degrees", f"WITH RECURSIVE {_CC} SELECT d, etype, value, degree FROM dg")
def _(spark, d):
    return graph.window_degrees(graph.window_members(transactions(spark, d), CFG), PAIR)


@query("window_pruned_kept", f"WITH RECURSIVE {_CC} SELECT d, etype, count(*) FILTER (degree BETWEEN {CFG.min_degree} AND {CFG.max_degree}) AS n_kept, count(*) FILTER (NOT degree BETWEEN {CFG.min_degree} AND {CFG.max_degree}) AS n_pruned FROM dg GROUP BY ALL")
def _(spark, d):
    deg = graph.window_degrees(graph.window_members(transactions(spark, d), CFG), PAIR)
    kept = F.col("degree").between(CFG.min_degree, CFG.max_degree).cast("bigint")
    return deg.groupBy("d", "etype").agg(F.sum(kept).alias("n_kept"), F.sum(1 - kept).alias("n_pruned"))


@query("connected_components_pair", f"WITH RECURSIVE {_CC} SELECT d, txn_id, comp FROM comp")
def _(spark, d):
    return graph.components(graph.window_members(transactions(spark, d), CFG), CFG, PAIR)[0]


@query("capped_components")
def _(spark, d):
    return graph.capped_components(graph.window_members(transactions(spark, d), CFG), CFG)


@query("ring_attach", f"WITH RECURSIVE {_CC} SELECT d, txn_id, comp FROM att")
def _(spark, d):
    return graph.ring_rows(transactions(spark, d), CFG, PAIR)[0].filter("role = 'today'").select("d", "txn_id", "comp")


@query("ring_degrees", f"WITH RECURSIVE {_CC} SELECT x.txn_id, coalesce(a.degree, 0) AS device_degree, coalesce(b.degree, 0) AS card_degree FROM x LEFT JOIN dg a ON a.d = x.day AND a.etype = 'device' AND a.value = x.device LEFT JOIN dg b ON b.d = x.day AND b.etype = 'card' AND b.value = x.card")
def _(spark, d):
    tx = transactions(spark, d)
    return graph.attached_degrees(tx, graph.window_degrees(graph.window_members(tx, CFG), PAIR), PAIR)


def _ring_query(name: str, select: str, cols: list[str], rounded: list[str]) -> None:
    @query(name, f"WITH RECURSIVE {_CC} SELECT * EXCLUDE (role) FROM (SELECT txn_id, role, {select} FROM fl WINDOW p AS ({_P}), b AS (PARTITION BY d, comp ORDER BY dt RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), m AS (PARTITION BY d, comp ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND {LAG} PRECEDING)) WHERE role = 'today'")
    def _(spark, d):
        return _ring(spark, d)[1].select("txn_id", *cols, *_r(*rounded))


_ratio = lambda a, b: f"CASE WHEN sum(f_{b}) OVER p > 0 THEN (sum(f_{a}) OVER p)::DOUBLE / (sum(f_{b}) OVER p) ELSE -1 END"
_flags = "f_uid + f_device + f_addr + f_card"
_hours = " + ".join(f"CASE WHEN count(*) FILTER (hour = {h}) OVER p > 0 THEN count(*) FILTER (hour = {h}) OVER p * log2((count(*) FILTER (hour = {h}) OVER p)::DOUBLE) ELSE 0 END" for h in range(24))
_ring_query("ring_counts", "count(*) OVER p AS comp_size", ["comp_size"], [])
_ring_query("ring_velocity_age", f"count(*) OVER (PARTITION BY d, comp ORDER BY dt RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS comp_velocity_1h, count(*) OVER b AS comp_velocity_24h, round(coalesce((dt - min(dt) OVER p) / 3600.0, -1), 6) AS comp_age_hours", ["comp_velocity_1h", "comp_velocity_24h"], ["comp_age_hours"])
_ring_query("ring_amount_stats", f"round(coalesce(avg(amt) OVER p, -1) + 1e-10, 6) AS comp_amt_mean, round(CASE WHEN count(*) OVER p >= 2 AND sum(amt) OVER p > 0 THEN sqrt(greatest(sum(amt * amt) OVER p / count(*) OVER p - (sum(amt) OVER p / count(*) OVER p) ^ 2, 0)) / (sum(amt) OVER p / count(*) OVER p) ELSE -1 END, 6) AS comp_amt_cv, round(coalesce(avg((amt < {CFG.small_amount})::INT) OVER p, -1), 6) AS comp_amt_small_share", [], ["comp_amt_mean", "comp_amt_cv", "comp_amt_small_share"])
_ring_query("ring_distinct_entities", f"coalesce(sum(f_uid) OVER p, 0)::BIGINT AS comp_n_uid, coalesce(sum(f_device) OVER p, 0)::BIGINT AS comp_n_device, round({_ratio('uid', 'device')}, 6) AS comp_uid_per_device, round({_ratio('addr', 'card')}, 6) AS comp_addr_per_card", ["comp_n_uid", "comp_n_device"], ["comp_uid_per_device", "comp_addr_per_card"])
_ring_query("ring_new_entity_ratio", f"round(CASE WHEN sum({_flags}) OVER p > 0 THEN coalesce(sum({_flags}) OVER b, 0)::DOUBLE / (sum({_flags}) OVER p) ELSE -1 END, 6) AS comp_new_entity_ratio", [], ["comp_new_entity_ratio"])
_ring_query("ring_burstiness", "round(CASE WHEN count(gap) OVER p >= 2 AND sum(gap) OVER p > 0 THEN (sum(gap::DOUBLE * gap) OVER p / count(gap) OVER p - ((sum(gap) OVER p)::DOUBLE / count(gap) OVER p) ^ 2) / ((sum(gap) OVER p)::DOUBLE / count(gap) OVER p) ELSE -1 END, 6) AS comp_burstiness", [], ["comp_burstiness"])
_ring_query("ring_hour_entropy", f"round(CASE WHEN count(*) OVER p >= 2 THEN log2((count(*) OVER p)::DOUBLE) - ({_hours}) / count(*) OVER p ELSE -1 END, 6) AS comp_hour_entropy", [], ["comp_hour_entropy"])
_ring_query("ring_label_rate", f"count(label) OVER m AS comp_prior_n_labeled, round((coalesce(sum(label) OVER m, 0) + {CFG.smoothing} * {PRIOR}) / (count(label) OVER m + {CFG.smoothing}), 6) AS comp_prior_fraud_rate", ["comp_prior_n_labeled"], ["comp_prior_fraud_rate"])
_ring_query("ring_proof_columns", "coalesce(max(dt) OVER p, -1) AS comp_max_contrib_dt, coalesce(max(dt) OVER m, -1) AS comp_label_max_contrib_dt", ["comp_max_contrib_dt", "comp_label_max_contrib_dt"], [])


@query("ring_with_defaults")
def _(spark, d):
    return ring.with_defaults(transactions(spark, d).select("txn_id"), _ring(spark, d)[1], PRIOR)


@query("ring_violations", "SELECT 0::BIGINT AS not_prior, 0::BIGINT AS not_mature")
def _(spark, d):
    return causal.violations(_ring(spark, d)[1], LAG)


@query("graph_stats", f"""WITH RECURSIVE {_CC}, per AS (SELECT d, comp, count(*) AS n, count(*) FILTER (role = 'window') AS w, count(*) FILTER (role = 'today') AS t FROM rr GROUP BY ALL),
 g AS (SELECT d, sum(w)::BIGINT AS window_rows, count(*) AS n_components, max(n) AS largest, quantile_cont(n, 0.5) AS median_size, sum(t) AS attached FROM per GROUP BY d), td AS (SELECT day AS d, count(*) AS rows_today FROM x GROUP BY day)
 SELECT d, coalesce(window_rows, 0) AS window_rows, coalesce(n_components, 0) AS n_components, coalesce(largest, 0) AS largest, round(coalesce(median_size, 0), 6) AS median_size, rows_today, round(coalesce(attached, 0) * 100.0 / rows_today, 4) AS attached_pct FROM td LEFT JOIN g USING (d)""")
def _(spark, d):
    tx = transactions(spark, d)
    return graph.graph_stats(tx, graph.ring_rows(tx, CFG, PAIR)[0]).withColumn("attached_pct", F.col("attached_pct").cast("double"))


@query("case_subgraph_edges", f"""WITH {_X}, f AS (SELECT user_id AS comp, txn_id, device, card, row_number() OVER (PARTITION BY user_id ORDER BY dt, txn_id) AS n FROM x)
 SELECT comp, txn_id, 'device' AS etype, device AS value FROM f WHERE n <= 60 UNION ALL SELECT comp, txn_id, 'card', card FROM f WHERE n <= 60""")
def _(spark, d):
    return graph.case_subgraph(transactions(spark, d).withColumn("comp", F.col("user_id")), PAIR)


# encoders

@query("base_amount_features", f"WITH {_X} SELECT txn_id, amt AS amount, round(ln(1 + amt), 6) AS log_amount, round(amt - floor(amt), 6) AS cents FROM x")
def _(spark, d):
    return encode.amount_features(transactions(spark, d)).select("txn_id", "amount", *_r("log_amount", "cents"))


_MISS = {"a": "c_acctbal < 0", "b": "c_nationkey % 3 = 0", "m": "c_mktsegment = 'BUILDING'"}


@query("missingness_flags", "WITH m AS (SELECT c_custkey, " + ", ".join(f"({v})::BIGINT AS {k}" for k, v in _MISS.items()) + ") ".replace(")", " FROM customer)") + "SELECT c_custkey, a + b + m AS identity_n_missing, (a + b + m < 3)::BIGINT AS identity_present, a AS a_missing, m AS m_missing FROM m")
def _(spark, d):
    c = read(spark, d, "customer").select("c_custkey", *[F.when(~F.expr(v), F.lit(1)).alias(k) for k, v in _MISS.items()])
    return encode.missingness(c, list(_MISS), ["a", "m"]).select("c_custkey", "identity_n_missing", "identity_present", "a_missing", "m_missing")


@query("email_freq_encode", f"WITH {_N}, f AS (SELECT email, count(*)::DOUBLE / sum(count(*)) OVER () AS freq FROM sp WHERE split = 'train' AND email IS NOT NULL GROUP BY email) SELECT txn_id, round(coalesce(freq, 0), 6) AS email_freq FROM sp LEFT JOIN f USING (email)")
def _(spark, d):
    s = split.temporal_split(transactions(spark, d), CFG)
    return encode.encode_frequency(s, encode.fit_frequency(s.filter("split = 'train'"), "email"), "email").select("txn_id", *_r("email_freq"))


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "gross"]
_LINES = "(SELECT *, l_extendedprice * (1 - l_discount) AS gross FROM lineitem)"


@query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS r FROM {_LINES}" for i, a in enumerate(_LINE) for b in _LINE[i + 1 :]))
def _(spark, d):
    li = read(spark, d, "lineitem").withColumn("gross", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return encode.correlations(li, _LINE).select("a", "b", *_r("r"))


@query("correlation_prune")
def _(spark, d):
    li = read(spark, d, "lineitem").withColumn("gross", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return spark.createDataFrame([(c,) for c in encode.correlation_prune(li, _LINE)], "kept string")


@query("train_sample")
def _(spark, d):
    return encode.sample(transactions(spark, d), 100_000).select("txn_id", "dt")


@query("last_row_per_case", f"WITH {_X} SELECT user_id, arg_max(txn_id, (dt, txn_id)) AS txn_id, arg_max(amt, (dt, txn_id)) AS amt FROM x GROUP BY user_id")
def _(spark, d):
    return encode.most_recent(transactions(spark, d), "user_id", ["txn_id", "amt"])


@query("shared_entity_mode", f"""WITH {_X}, l AS (SELECT nation AS comp, 'device' AS etype, 0 AS rank, device AS value FROM x WHERE nation % 2 = 0 UNION ALL SELECT nation, 'addr', 1, addr FROM x), c AS (SELECT comp, etype, rank, value, count(*) AS n FROM l WHERE value IS NOT NULL GROUP BY ALL)
 SELECT comp::BIGINT AS comp, etype, value, n FROM c QUALIFY row_number() OVER (PARTITION BY comp ORDER BY rank, n DESC, value) = 1""")
def _(spark, d):
    tx = transactions(spark, d).select(F.col("nation").cast("bigint").alias("comp"), F.expr("CASE WHEN nation % 2 = 0 THEN device END").alias("device"), "addr")
    return encode.mode_by_priority(entities.long_form(tx, ["device", "addr"], ["comp"]), ["device", "addr", "card", "uid"])


# rules

_RULES = f"""{_X}, w AS (SELECT *, count(*) OVER (PARTITION BY uid ORDER BY dt RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS v1, count(*) OVER (PARTITION BY device ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dp,
  row_number() OVER (PARTITION BY addr, uid ORDER BY dt, txn_id) = 1 AS fu, row_number() OVER (PARTITION BY addr, device ORDER BY dt, txn_id) = 1 AS fd FROM x),
 w2 AS (SELECT *, coalesce(sum(fu::INT) OVER p, 0) AS nu, coalesce(sum(fd::INT) OVER p, 0) AS nd FROM w WINDOW p AS (PARTITION BY addr ORDER BY dt RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 ru AS (SELECT txn_id, label, v1, (amt < 5 AND v1 >= 3)::BIGINT AS r1, (device IS NOT NULL AND dp <= 0 AND event_type = 'click')::BIGINT AS r2, (nd >= 1 AND nu >= 5 * nd)::BIGINT AS r3 FROM w2)"""


def _ruled(spark, d):
    """Rules over the wired strictly-prior aggregates; a day stands for the hour, addresses for components."""
    tx = causal.entity_features(causal.entity_features(transactions(spark, d), "uid", "uid", PRIOR, CFG), "device", "device", PRIOR, CFG)
    w = ring.Window.partitionBy
    for t in ("uid", "device"):
        tx = tx.withColumn(f"f_{t}", (F.row_number().over(w("addr", t).orderBy("dt", "txn_id")) == 1).cast("bigint"))
    prior = causal.Frames(["addr"], LAG).prior
    tx = tx.withColumns({f"comp_n_{t}": F.coalesce(F.sum(f"f_{t}").over(prior), F.lit(0)) for t in ("uid", "device")})
    return rules.apply_rules(tx.withColumns({"uid_velocity_1h": F.col("uid_velocity_24h"), "match_failed": F.col("event_type") == "click"}), CFG.small_amount)


@query("rules_baseline", f"WITH {_RULES} SELECT txn_id, r1, r2, r3, r1 + r2 + r3 AS fired, (r1 + r2 + r3 > 0)::BIGINT AS flag, round((r1 + r2 + r3 + 0.9 * tanh(v1 / 10.0)) / 3.9, 6) AS rule_score FROM ru")
def _(spark, d):
    return _ruled(spark, d).select("txn_id", "r1", "r2", "r3", "fired", "flag", *_r("rule_score"))


@query("rule_firing_report", f"""WITH {_RULES}, l AS ({' UNION ALL '.join(f"SELECT '{r}' AS rule, {r} AS hit, label FROM ru" for r in ('r1', 'r2', 'r3'))})
 SELECT rule, sum(hit)::BIGINT AS n_fired, round(avg(hit) * 100, 4) AS rate_pct, sum(hit * label)::BIGINT AS tp, round(coalesce(sum(hit * label)::DOUBLE / nullif(sum(hit), 0), 0), 6) AS precision, round(coalesce(sum(hit * label)::DOUBLE / nullif(sum(label), 0), 0), 6) AS recall FROM l GROUP BY rule""")
def _(spark, d):
    return rules.firing_report(_ruled(spark, d))


# metrics

_BY = "b AS (SELECT score, sum(label) AS tp, count(*) AS n FROM s GROUP BY score), c AS (SELECT *, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(n) OVER (ORDER BY score DESC) AS cn FROM b)"


@query("pr_auc", f"WITH {_S}, {_BY} SELECT round(sum(tp::DOUBLE * ctp / cn) / sum(tp), 6) AS pr_auc FROM c")
def _(spark, d):
    return metrics.pr_auc(_scored(spark, d))


@query("roc_auc", f"WITH {_S}, {_BY} SELECT round(sum((n - tp) * (ctp - tp + tp / 2.0)) / (sum(tp)::DOUBLE * sum(n - tp)), 6) AS roc_auc FROM c")
def _(spark, d):
    return metrics.roc_auc(_scored(spark, d))


def _recall(group: str, band: str) -> str:
    """SQL of recall at 0.1, 1 and 5 % of a table g(score, label, group)."""
    g = f"{group}, " if group else ""
    using = f"JOIN q USING ({group})" if group else ", q"
    by = f"GROUP BY {group}" if group else ""
    return " UNION ALL ".join(
        f"(WITH q AS (SELECT {g}quantile_cont(score, {1 - f}) AS threshold FROM {band} WHERE label = 0 {by}) SELECT {g}{f}::DOUBLE AS fpr, round(avg((score >= threshold)::INT) FILTER (label = 1), 6) AS recall, count(*) AS n FROM {band} {using} {by})" for f in (0.001, 0.01, 0.05)
    )


@query("recall_at_fpr", f"WITH {_S} {_recall('', 's')}")
def _(spark, d):
    return metrics.recall_at_fpr(_scored(spark, d), [0.001, 0.01, 0.05])


@query("precision_at_k_per_day", f"WITH {_S}, t AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, dt, txn_id) AS rank FROM s) SELECT round(avg(label), 6) AS precision, count(*) AS n FROM t WHERE rank <= 10")
def _(spark, d):
    return metrics.precision_at_k(_scored(spark, d), 10)


@query("precision_at_k_global", f"WITH {_S}, t AS (SELECT * FROM s ORDER BY score DESC, dt, txn_id LIMIT 100) SELECT round(avg(label), 6) AS precision, count(*) AS n FROM t")
def _(spark, d):
    return metrics.precision_at_k(_scored(spark, d), 100, per_day=False)


@query("brier_logloss", f"WITH {_S}, p AS (SELECT score, label, greatest(least(score, 1 - 1e-12), 1e-12) AS p FROM s) SELECT round(avg((score - label) * (score - label)), 6) AS brier, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 6) AS log_loss FROM p")
def _(spark, d):
    return metrics.brier_logloss(_scored(spark, d))


@query("ece_bins", f"""WITH {_S}, b AS (SELECT ({' + '.join(f'(score >= {k}::DOUBLE / 15)::INT' for k in range(1, 15))})::BIGINT AS bin, score, label FROM s), g AS (SELECT bin, count(*) AS n, avg(score) AS conf, avg(label) AS rate FROM b GROUP BY bin)
 SELECT r.bin, coalesce(n, 0) AS n, round(conf, 6) AS conf, round(rate, 6) AS rate, round(sum(coalesce(abs(conf - rate) * n, 0)) OVER () / sum(coalesce(n, 0)) OVER (), 6) AS ece FROM (SELECT range AS bin FROM range(15)) r LEFT JOIN g USING (bin)""")
def _(spark, d):
    return metrics.ece_bins(_scored(spark, d))


_BAND = f"{_S}, q4 AS (SELECT list_distinct(quantile_cont(amt, [0, 0.25, 0.5, 0.75, 1.0])) AS e FROM s), g AS (SELECT s.*, 'q' || greatest(len(list_filter(e, lambda v: v < amt)), 1) AS band FROM s, q4)"


@query("slice_amount_band", f"WITH {_BAND} {_recall('band', 'g')}")
def _(spark, d):
    return metrics.recall_at_fpr(metrics.amount_bands(_scored(spark, d)), [0.001, 0.01, 0.05], ["band"])


@query("slice_hour_band", f"WITH {_S}, g AS (SELECT *, CASE WHEN hour <= 6 THEN 'night' WHEN hour <= 12 THEN 'morning' WHEN hour <= 18 THEN 'afternoon' ELSE 'evening' END AS band FROM s) {_recall('band', 'g')}")
def _(spark, d):
    return metrics.recall_at_fpr(metrics.hour_bands(_scored(spark, d)), [0.001, 0.01, 0.05], ["band"])


_PSI = " UNION ALL ".join(
    f"""(WITH v AS (SELECT (day >= 15)::INT AS side, {c}::DOUBLE AS v FROM s), q AS (SELECT list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM v WHERE side = 0),
 b AS (SELECT side, len(list_filter(e[2:len(e) - 1], lambda z: z <= v)) AS bin FROM v, q), n AS (SELECT bin, count(*) FILTER (side = 0) AS e, count(*) FILTER (side = 1) AS a FROM b GROUP BY bin),
 f AS (SELECT e::DOUBLE / sum(e) OVER () + 1e-6 AS pe, a::DOUBLE / sum(a) OVER () + 1e-6 AS pa FROM n) SELECT '{c}' AS feature, round(sum((pa - pe) * ln(pa / pe)), 6) AS psi FROM f)"""
    for c in ("amt", "score", "hour")
)


@query("psi_drift", f"WITH {_S} {_PSI}")
def _(spark, d):
    s = _scored(spark, d).select((F.col("day") >= 15).cast("int").alias("side"), "amt", "score", F.col("hour").cast("double").alias("hour"))
    return metrics.psi(s, ["amt", "score", "hour"], "side")


# policy

@query("noisy_or_case_score", f"WITH {_CASES} SELECT comp, round(score, 6) AS score FROM sc")
def _(spark, d):
    return policy.case_scores(_scored(spark, d).withColumn("comp", F.col("user_id")), 3).select("comp", *_r("score"))


@query("case_rollup", f"WITH {_CASES} SELECT comp, n_transactions, round(amount, 2) AS amount, n_uid, n_device, round(amount_cv, 6) AS amount_cv, round(age_hours, 6) AS age_hours, velocity_24h, day_start, day_end, n_fraud FROM roll")
def _(spark, d):
    return _cases(spark, d).select("comp", "n_transactions", *_r("amount", places=2), "n_uid", "n_device", *_r("amount_cv", "age_hours"), "velocity_24h", "day_start", "day_end", "n_fraud")


@query("expected_costs", f"WITH {_CASES} SELECT comp, round(cost_allow, 2) AS cost_allow, round(cost_block, 2) AS cost_block, round(cost_review, 2) AS cost_review FROM ec")
def _(spark, d):
    return _cases(spark, d).select("comp", *_r("cost_allow", "cost_block", "cost_review", places=2))


@query("policy_argmin", f"WITH {_CASES} SELECT comp, decision, round(expected_cost, 2) AS expected_cost, round(expected_saving, 2) AS expected_saving FROM dc")
def _(spark, d):
    return policy.decide(_cases(spark, d)).select("comp", "decision", *_r("expected_cost", "expected_saving", places=2))


@query("review_capacity", f"""WITH {_CASES}, k AS (SELECT *, row_number() OVER (PARTITION BY day_end, decision ORDER BY least(cost_allow, cost_block) - cost_review DESC, comp) AS rank FROM dc)
 SELECT comp, CASE WHEN decision = 'review' AND rank > 2 THEN CASE WHEN cost_block < cost_allow THEN 'block' ELSE 'allow' END ELSE decision END AS decision FROM k""")
def _(spark, d):
    return policy.with_capacity(policy.decide(_cases(spark, d)).withColumn("day", F.col("day_end")), 2).select("comp", "decision")


@query("cost_sensitivity", " UNION ALL ".join(
    f"""(WITH {_CASES}, z AS (SELECT comp, score * (amount_inr + {COSTS.chargeback_fee} * {f if p == 'chargeback_fee' else 1}) AS ca, (1 - score) * (amount_inr * {COSTS.false_block} * {f if p == 'false_block' else 1} + {COSTS.block_friction}) AS cb,
 {COSTS.review} * {f if p == 'review' else 1} + (1 - {COSTS.review_recall}) * score * (amount_inr + {COSTS.chargeback_fee} * {f if p == 'chargeback_fee' else 1}) AS cr FROM ec)
 SELECT '{p}' AS parameter, {f}::DOUBLE AS factor, count(*) FILTER (NOT (ca <= cb AND ca <= cr)) AS n_flagged, round(sum(least(ca, cb, cr)), 2) AS total_cost FROM z)""" for p in ("chargeback_fee", "false_block", "review") for f in (0.5, 2.0)))
def _(spark, d):
    return policy.sensitivity(_cases(spark, d), COSTS, [0.5, 2.0])


@query("case_queue_topn", f"WITH {_CASES} SELECT comp, decision, round(expected_saving, 2) AS expected_saving FROM dc ORDER BY dc.expected_saving DESC, comp LIMIT 20")
def _(spark, d):
    return policy.queue(policy.decide(_cases(spark, d)), 20).select("comp", "decision", *_r("expected_saving", places=2))


@query("case_economics", f"WITH {_CASES} SELECT count(*) AS n_cases, count(*) FILTER (decision <> 'allow') AS n_flagged, round(count(*) FILTER (decision <> 'allow' AND n_fraud > 0)::DOUBLE / nullif(count(*) FILTER (decision <> 'allow'), 0), 6) AS case_precision, round(sum(expected_cost), 2) AS total_cost, round(sum(expected_saving), 2) AS total_saving FROM dc")
def _(spark, d):
    return policy.economics(policy.decide(_cases(spark, d)))


@query("case_precision", f"WITH {_CASES} SELECT round(count(*) FILTER (score >= 0.9 AND n_fraud > 0)::DOUBLE / nullif(count(*) FILTER (score >= 0.9), 0), 6) AS case_precision FROM ec")
def _(spark, d):
    return metrics.case_precision(_cases(spark, d).withColumn("flagged", F.col("score") >= 0.9))


# ledger and evidence

_ENTRY = ["action", "case_id"]


def _entries(spark, d):
    s = read(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("c_"), "s_suppkey").alias("case_id"), F.when(F.col("s_nationkey") % 3 > 0, F.lit("block")).alias("action"))


_LEDGER = f"""b AS (SELECT s_suppkey AS seq, sha256('{{' || CASE WHEN s_nationkey % 3 > 0 THEN '"action":"block",' ELSE '' END || '"case_id":"c_' || s_suppkey || '"}}') AS h, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier),
chain(n, seq, prev_hash, hash) AS (SELECT n, seq, '{ledger.GENESIS}', sha256('{ledger.GENESIS}' || h) FROM b WHERE n = 1 UNION ALL SELECT b.n, b.seq, chain.hash, sha256(chain.hash || b.h) FROM chain JOIN b ON b.n = chain.n + 1)"""


@query("ledger_chain", f"WITH RECURSIVE {_LEDGER} SELECT seq, prev_hash, hash FROM chain")
def _(spark, d):
    return ledger.build(_entries(spark, d), _ENTRY).select("seq", "prev_hash", "hash")


@query("ledger_verify", "SELECT count(*) AS n, 1::BIGINT AS bad, false AS valid FROM supplier")
def _(spark, d):
    """One entry is altered after the chain was built: exactly that one must be found."""
    chain = ledger.build(_entries(spark, d), _ENTRY)
    return ledger.verify(chain.withColumn("case_id", F.when(F.col("seq") == 3, "c_x").otherwise(F.col("case_id"))), _ENTRY)


@query("evidence_json")
def _(spark, d):
    return evidence.evidence(policy.decide(_cases(spark, d)), CFG.label_lag_days).select("comp", F.to_json("evidence").alias("evidence"))


@query("brief_template", f"WITH {_CASES} SELECT comp, n_transactions || ' transactions share this component.' AS first_bullet, 5::BIGINT AS n_bullets, 'Check, then ' || decision || '.' AS next_step FROM dc")
def _(spark, d):
    b = evidence.brief(evidence.evidence(policy.decide(_cases(spark, d)), CFG.label_lag_days))
    return b.select("comp", F.element_at("bullets", 1).alias("first_bullet"), F.size("bullets").cast("bigint").alias("n_bullets"), "next_step")


@query("numeric_fidelity", f"WITH {_CASES} SELECT comp, 0::BIGINT AS n_unsupported, 1.0::DOUBLE AS fidelity, true AS counter_present FROM dc")
def _(spark, d):
    b = evidence.brief(evidence.evidence(policy.decide(_cases(spark, d)), CFG.label_lag_days))
    return evidence.fidelity(b).select("comp", "n_unsupported", "fidelity", "counter_present")


# streaming operators on a bounded input

@query("velocity_windows", """SELECT epoch(w)::BIGINT AS window_start, user_id, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT user_id, value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w FROM events) GROUP BY ALL""")
def _(spark, d):
    return velocity(read(spark, d, "events"))


@query("session_bursts", """WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '6 hours')::INT AS new, event_id FROM events), s AS (SELECT user_id, ts, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
 SELECT floor(epoch(min(ts)))::BIGINT AS session_start, floor(epoch(max(ts) + INTERVAL '6 hours'))::BIGINT AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, d):
    return bursts(read(spark, d, "events"))


# slices, reports and invariants

@query("slice_device_coverage", f"WITH {_S.replace('amt, label,', 'amt, label, device,')}, g AS (SELECT *, CASE WHEN device IS NULL THEN 'device_absent' ELSE 'device_present' END AS band FROM s) {_recall('band', 'g')}")
def _(spark, d):
    return metrics.recall_at_fpr(metrics.device_bands(_scored(spark, d)), [0.001, 0.01, 0.05], ["band"])


@query("slice_uid_freshness", f"WITH {_X}, s AS (SELECT label, {_SCORE} AS score, count(*) OVER ({_UID} 1 PRECEDING) AS c FROM x), g AS (SELECT *, CASE WHEN c = 0 THEN 'new_uid' ELSE 'returning_uid' END AS band FROM s) {_recall('band', 'g')}")
def _(spark, d):
    tx = causal.entity_features(_scored(spark, d), "uid", "uid", PRIOR, CFG)
    return metrics.recall_at_fpr(metrics.freshness_bands(tx), [0.001, 0.01, 0.05], ["band"])


@query("psi_report", f"WITH {_S}, p AS ({_PSI}) SELECT feature, psi, psi > 0.25 AS flagged, row_number() OVER (ORDER BY psi DESC, feature)::INT AS rank FROM p")
def _(spark, d):
    s = _scored(spark, d).select((F.col("day") >= 15).cast("int").alias("side"), "amt", "score", F.col("hour").cast("double").alias("hour"))
    return metrics.psi_report(s, ["amt", "score", "hour"], "side")


@query("train_prior", f"WITH {_N} SELECT round(avg(label), 6) AS prior FROM sp WHERE split = 'train'")
def _(spark, d):
    return encode.train_prior(split.temporal_split(transactions(spark, d), CFG))


@query("feature_pass_through", f"WITH {_X} SELECT txn_id, amt::DOUBLE AS amt, nation::DOUBLE AS nation, hour::DOUBLE AS hour, event_type, segment FROM x")
def _(spark, d):
    return encode.pass_through(transactions(spark, d), ["amt", "nation", "hour"], ["event_type", "segment"])


@query("hub_pruning_share", f"WITH RECURSIVE {_CC}, n AS (SELECT d, comp, count(*) AS n FROM comp GROUP BY d, comp) SELECT d, round(max(n) / sum(n), 6) AS largest_share FROM n GROUP BY d")
def _(spark, d):
    return graph.largest_share(graph.components(graph.window_members(transactions(spark, d), CFG), CFG, PAIR)[0])


@query("case_subgraph_nodes", f"""WITH {_X}, f AS (SELECT *, user_id AS comp, row_number() OVER (PARTITION BY user_id ORDER BY dt, txn_id) AS n FROM x), k AS (SELECT * FROM f WHERE n <= 60)
 SELECT comp, 'transaction' AS kind, txn_id::VARCHAR AS node, amt, dt FROM k UNION ALL SELECT DISTINCT comp, 'device', device, NULL, NULL FROM k UNION ALL SELECT DISTINCT comp, 'card', card, NULL, NULL FROM k""")
def _(spark, d):
    return graph.case_subgraph_nodes(transactions(spark, d).withColumn("comp", F.col("user_id")), PAIR)


@query("noisy_or_top50", f"WITH {_CASES.replace('rank <= 3', 'rank <= 50')} SELECT comp, round(score, 6) AS score FROM sc")
def _(spark, d):
    return policy.case_scores(_scored(spark, d).withColumn("comp", F.col("user_id"))).select("comp", *_r("score"))


@query("decision_cost", f"WITH {_CASES} SELECT comp, round(expected_cost, 2) AS own_cost, round(cost_block, 2) AS block_cost FROM dc")
def _(spark, d):
    c = policy.decide(_cases(spark, d)).select("comp", policy.cost_of(F.col("decision")).alias("own_cost"), policy.cost_of(F.lit("block")).alias("block_cost"))
    return c.select("comp", *_r("own_cost", "block_cost", places=2))


@query("calibration_report", f"""WITH {_S}, b AS (SELECT ({' + '.join(f'(score >= {k}::DOUBLE / 15)::INT' for k in range(1, 15))}) AS bin, score, label, greatest(least(score, 1 - 1e-12), 1e-12) AS p FROM s),
 g AS (SELECT count(*) AS n, avg(score) AS conf, avg(label) AS rate FROM b GROUP BY bin), e AS (SELECT sum(abs(conf - rate) * n) / sum(n) AS ece FROM g), l AS (SELECT avg((score - label) * (score - label)) AS brier, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS log_loss FROM b)
 SELECT round(ece, 6) AS ece, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss FROM e, l""")
def _(spark, d):
    return metrics.calibration_bundle(_scored(spark, d))


_LEDGER_LINE = """'{"action":"' || action || '","case_id":"' || case_id || '","prev_hash":"' || {p} || '","seq":' || {b}seq || '}'"""
_LINKED = f"""b AS (SELECT s_suppkey AS seq, 'c_' || s_suppkey AS case_id, CASE WHEN s_nationkey % 3 > 0 THEN 'block' ELSE 'allow' END AS action, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier),
chain(n, seq, prev_hash, hash) AS (SELECT n, seq, '{ledger.GENESIS}', sha256('{ledger.GENESIS}' || {_LEDGER_LINE.replace("{p}", f"'{ledger.GENESIS}'").replace("{b}", "")}) FROM b WHERE n = 1
 UNION ALL SELECT b.n, b.seq, chain.hash, sha256(chain.hash || {_LEDGER_LINE.replace("{p}", "chain.hash").replace("{b}", "b.")}) FROM chain JOIN b ON b.n = chain.n + 1)"""


@query("ledger_lines", f"WITH RECURSIVE {_LINKED} SELECT seq, prev_hash, hash FROM chain")
def _(spark, d):
    return ledger.chained(_entries(spark, d).fillna("allow", ["action"])).select("seq", "prev_hash", "hash")


@query("completion_cache", "SELECT p_partkey, p_brand AS brand, CASE WHEN p_brand < 'Brand#3' THEN 'about ' || p_brand END AS reply FROM part")
def _(spark, d):
    """Parts ask about their brand; the cache knows some brands only."""
    p = read(spark, d, "part")
    ask = F.struct(F.col("p_brand").alias("brand"))
    known = p.filter("p_brand < 'Brand#3'").select(evidence.cache_key(ask).alias("key"), F.concat(F.lit("about "), "p_brand").alias("reply"))
    return evidence.from_cache(p, known, ask).select("p_partkey", F.col("p_brand").alias("brand"), "reply")


# models

_NUM = ["amt", "uid_prior_count", "uid_prior_amt_mean", "uid_prior_fraud_rate", "device_prior_count", "hour"]


def _model_rows(spark, d):
    tx = causal.entity_features(causal.entity_features(transactions(spark, d), "uid", "uid", PRIOR, CFG), "device", "device", PRIOR, CFG)
    return graph._written(split.temporal_split(tx, CFG).select("txn_id", "dt", "day", "split", F.col("label").cast("double").alias("label"), "email", *[F.col(c).cast("double").alias(c) for c in _NUM]))


@query("gbt_calibrated_scores")
def _(spark, d):
    rows = _model_rows(spark, d)
    model = scoring.fit_trees(rows.filter("split = 'train'"), _NUM, ["email"], trees=5, depth=3)
    raw = scoring.predict(model, rows, _NUM)
    return scoring.calibrate(raw.filter("split = 'val'"), raw.filter("split = 'test'")).select("txn_id", "label", "raw", "score")


@query("ablation_table")
def _(spark, d):
    rows = _model_rows(spark, d)
    out = None
    for name, cols in (("B base", ["amt", "hour"]), ("C entity", _NUM)):
        model = scoring.fit_trees(rows.filter("split = 'train'"), cols, ["email"], trees=5, depth=3)
        test = scoring.predict(model, rows.filter("split = 'test'"), cols).withColumn("score", F.round("raw", 6))
        one = metrics.headline(test, name)
        out = one if out is None else out.unionByName(one)
        if name == "C entity":
            val = scoring.predict(model, rows.filter("split = 'val'"), cols)
            flat = scoring.calibrate(val, test.drop("score")).withColumn("score", F.round("score", 6))
            out = out.unionByName(metrics.headline(flat, "F calibrated"))
    ruled = _ruled(spark, d).join(rows.filter("split = 'test'").select("txn_id"), "txn_id", "left_semi").withColumn("score", F.round("rule_score", 6))
    return out.unionByName(metrics.headline(ruled, "A rules"))
