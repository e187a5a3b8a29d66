"""Rules baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_rules(df: DataFrame, small: float = 5.0) -> DataFrame:
    """r1: a small amount after three in the hour; r2: a device never seen before with a failed match; r3: five users a device.

    df: amt, uid_velocity_1h, device, device_prior_count, match_failed (boolean), comp_n_uid, comp_n_device.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    r = {
        "r1": flag((F.col("amt") < small) & (F.col("uid_velocity_1h") >= 3)),
        "r2": flag(F.col("device").isNotNull() & (F.col("device_prior_count") <= 0) & F.col("match_failed")),
        "r3": flag((F.col("comp_n_device") >= 1) & (F.col("comp_n_uid") >= 5 * F.col("comp_n_device"))),
    }
    df = df.withColumns(r).withColumn("fired", F.col("r1") + F.col("r2") + F.col("r3"))
    return df.withColumns({"flag": (F.col("fired") > 0).cast("bigint"), "rule_score": (F.col("fired") + 0.9 * F.tanh(F.col("uid_velocity_1h") / 10.0)) / 3.9})


def firing_report(df: DataFrame) -> DataFrame:
    long = df.selectExpr("label", "stack(3, 'r1', r1, 'r2', r2, 'r3', r3) AS (rule, hit)")
    per = long.groupBy("rule").agg(F.sum("hit").alias("n_fired"), F.round(F.avg("hit") * 100, 4).alias("rate_pct"), F.sum(F.col("hit") * F.col("label")).alias("tp"), F.sum("label").alias("p"))
    return per.select(
        "rule", "n_fired", "rate_pct", "tp", F.round(F.coalesce(F.try_divide(F.col("tp"), F.col("n_fired")), F.lit(0.0)), 6).alias("precision"),
        F.round(F.coalesce(F.try_divide(F.col("tp"), F.col("p")), F.lit(0.0)), 6).alias("recall"),
    )
