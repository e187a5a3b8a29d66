"""Case scores, expected costs, decisions, the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, Costs
from ..functions.scalars import noisy_or

DECISIONS = ("block", "allow", "escalate")


def case_scores(df: DataFrame, top: int = 50) -> DataFrame:
    """(comp, score): noisy-OR of each case's `top` highest probabilities."""
    w = Window.partitionBy("comp").orderBy(F.desc("score"), "txn_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).groupBy("comp").agg(noisy_or(F.col("score")).alias("score"))


def expected_costs(df: DataFrame, c: Costs, factors: dict[str, Column] | None = None) -> DataFrame:
    """Adds cost_allow, cost_block, cost_review from score and amount_inr; factors scale single parameters."""
    s = lambda name: F.lit(getattr(c, name)) * (factors or {}).get(name, F.lit(1.0))
    p, amt = F.col("score"), F.col("amount_inr")
    allow = p * (amt + s("chargeback_fee"))
    block = (1 - p) * (amt * s("false_block") + s("block_friction"))
    return df.withColumns({"cost_allow": allow, "cost_block": block, "cost_review": s("review") + (1 - s("review_recall")) * allow})


def decide(df: DataFrame) -> DataFrame:
    """The cheapest action; ties: allow before block before review."""
    a, b, r = F.col("cost_allow"), F.col("cost_block"), F.col("cost_review")
    df = df.withColumn("decision", F.when((a <= b) & (a <= r), "allow").when(b <= r, "block").otherwise("review"))
    cost = F.least(a, b, r)
    return df.withColumns({"expected_cost": cost, "expected_saving": a - cost})


def with_capacity(df: DataFrame, per_day: int, order: str = "saving_desc") -> DataFrame:
    """At most per_day reviews a day; the others fall to the cheaper of block and allow (block only if strictly cheaper).

    order: 'saving_desc' keeps the reviews that save most, 'literal' those with the cheapest alternative.
    """
    other = F.least("cost_allow", "cost_block")
    by = [F.desc(other - F.col("cost_review"))] if order == "saving_desc" else [other.asc()]
    rank = F.row_number().over(Window.partitionBy("day", "decision").orderBy(*by, "comp"))
    over = (F.col("decision") == "review") & (F.col("rank") > per_day)
    fall = F.when(F.col("cost_block") < F.col("cost_allow"), "block").otherwise("allow")
    return df.withColumn("rank", rank).withColumn("decision", F.when(over, fall).otherwise(F.col("decision"))).drop("rank")


def case_rollup(df: DataFrame, cfg: Config) -> DataFrame:
    """Cases (components with at least two rows). df: comp, txn_id, dt, day, amt, label, uid, device."""
    last = F.max("dt").over(Window.partitionBy("comp"))
    df = df.filter("comp >= 0").withColumn("recent", (last - F.col("dt") <= 86400).cast("bigint"))
    mean, sq = F.avg("amt"), F.avg(F.col("amt") * F.col("amt"))
    return df.groupBy("comp").agg(
        F.count(F.lit(1)).alias("n_transactions"), F.sum("amt").alias("amount"), F.countDistinct("uid").alias("n_uid"), F.countDistinct("device").alias("n_device"),
        F.when(mean > 0, F.sqrt(F.greatest(sq - mean * mean, F.lit(0.0))) / mean).otherwise(-1.0).alias("amount_cv"), ((F.max("dt") - F.min("dt")) / 3600.0).alias("age_hours"),
        F.sum("recent").alias("velocity_24h"), F.min("day").alias("day_start"), F.max("day").alias("day_end"), F.sum("label").alias("n_fraud"),
    ).filter("n_transactions >= 2").withColumn("amount_inr", F.col("amount") * cfg.usd_inr)


def queue(cases: DataFrame, n: int) -> DataFrame:
    return cases.orderBy(F.desc("expected_saving"), "comp").limit(n)


def economics(cases: DataFrame) -> DataFrame:
    flagged = F.col("decision") != "allow"
    n = F.sum(flagged.cast("bigint"))
    return cases.agg(
        F.count(F.lit(1)).alias("n_cases"), n.alias("n_flagged"), F.round(F.try_divide(F.sum((flagged & (F.col("n_fraud") > 0)).cast("bigint")), n), 6).alias("case_precision"),
        F.round(F.sum("expected_cost"), 2).alias("total_cost"), F.round(F.sum("expected_saving"), 2).alias("total_saving"),
    )


def sensitivity(cases: DataFrame, c: Costs, factors: list[float]) -> DataFrame:
    """Decisions under each cost parameter scaled by each factor; the grid is a few rows."""
    names = ["chargeback_fee", "false_block", "review"]
    grid = cases.sparkSession.createDataFrame([(p, f) for p in names for f in factors], "parameter string, factor double")
    both = cases.crossJoin(F.broadcast(grid))
    scale = {p: F.when(F.col("parameter") == p, F.col("factor")).otherwise(1.0) for p in names}
    out = decide(expected_costs(both, c, scale))
    return out.groupBy("parameter", "factor").agg(F.sum((F.col("decision") != "allow").cast("bigint")).alias("n_flagged"), F.round(F.sum("expected_cost"), 2).alias("total_cost"))


def check_decision(name: str) -> str:
    if name not in DECISIONS:
        raise ValueError(f"decision must be one of {DECISIONS}")
    return name


def cost_of(decision: Column) -> Column:
    """The expected cost of any action on a row with its three costs; null for an unknown one."""
    return F.element_at(F.create_map(*[x for a in ("allow", "block", "review") for x in (F.lit(a), F.col(f"cost_{a}"))]), decision)
