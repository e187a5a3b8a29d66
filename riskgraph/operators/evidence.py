"""Evidence of a case, the template brief, and how faithful a brief's numbers are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import numbers_in


def evidence(cases: DataFrame, lag_days: int) -> DataFrame:
    """Adds evidence, a nested struct with its rounding contract."""
    s = F.struct(
        F.concat(F.lit("c_"), F.format_string("%05d", F.col("comp"))).alias("case_id"), F.round("score", 4).alias("score"), "decision", F.round("expected_cost", 2).alias("expected_cost"),
        F.struct("n_transactions", "n_uid", "n_device", F.round("amount_inr", 2).alias("amount_total_inr"), F.round("amount_cv", 4).alias("amount_cv"), F.round("age_hours", 2).alias("age_hours"), "velocity_24h").alias("component"),
        F.round(F.coalesce(F.try_divide(F.col("n_uid"), F.col("n_device")), F.lit(0.0)), 2).alias("uid_per_device"), F.lit(lag_days).alias("label_lag_days"),
    )
    return cases.withColumn("evidence", s)


def brief(df: DataFrame) -> DataFrame:
    """Adds summary, bullets (3 to 5), counter and next_step from evidence."""
    e = lambda c: F.col(f"evidence.{c}").cast("string")
    c = lambda x: e(f"component.{x}")
    bullets = F.slice(F.array(
        F.concat(c("n_transactions"), F.lit(" transactions share this component.")), F.concat(c("n_uid"), F.lit(" users over "), c("n_device"), F.lit(" devices.")),
        F.concat(c("velocity_24h"), F.lit(" transactions in its last 24 hours.")), F.concat(F.lit("Active for "), c("age_hours"), F.lit(" hours.")),
        F.concat(F.lit("Spread of amounts "), c("amount_cv"), F.lit(".")),
    ), 1, 5)
    return df.withColumns({
        "summary": F.concat(F.lit("Case "), e("case_id"), F.lit(" scores "), e("score"), F.lit("; suggested: "), e("decision"), F.lit(".")), "bullets": bullets,
        "counter": F.lit("Shared devices or addresses can also be a household, an office or a campus."), "next_step": F.concat(F.lit("Check, then "), e("decision"), F.lit(".")),
    })


def evidence_numbers() -> Column:
    """Every number that the evidence states, those inside texts too."""
    own = ["score", "expected_cost", "uid_per_device", "label_lag_days", *[f"component.{x}" for x in ("n_transactions", "n_uid", "n_device", "amount_total_inr", "amount_cv", "age_hours", "velocity_24h")]]
    values = F.array(*[F.round(F.col(f"evidence.{c}").cast("double"), 6) for c in own])
    return F.array_union(values, numbers_in(F.concat_ws(" ", "evidence.case_id", F.lit("24"))))


def fidelity(df: DataFrame) -> DataFrame:
    """Adds n_numbers, n_unsupported, fidelity (1 without numbers) and counter_present."""
    text = F.concat_ws(" ", "summary", F.array_join("bullets", " "), "counter", "next_step")
    df = df.withColumns({"_said": numbers_in(text), "_known": evidence_numbers()})
    bad = F.size(F.filter("_said", lambda x: ~F.array_contains("_known", x)))
    df = df.withColumns({"n_numbers": F.size("_said").cast("bigint"), "n_unsupported": bad.cast("bigint")})
    value = 1 - F.coalesce(F.try_divide(F.col("n_unsupported"), F.col("n_numbers")), F.lit(0.0))
    return df.withColumns({"fidelity": F.round(value, 6), "counter_present": F.length("counter") > 0}).drop("_said", "_known")


def parse_verdict(reply: Column) -> Column:
    """yes, no or partial from a judge's reply, its <think> part left out; anything else: unparsed."""
    x = F.lower(F.trim(F.regexp_replace(reply, r"(?s)<think>.*?(</think>|\z)", "")))
    word = F.regexp_extract(x, r"^(yes|no|partial)\b", 1)
    return F.when(word != "", word).otherwise("unparsed")


def cache_key(request: Column) -> Column:
    return F.sha2(F.to_json(request), 256)


def from_cache(df: DataFrame, cache: DataFrame, request: Column) -> DataFrame:
    """Adds reply from a cache (key, reply), null where the request was never answered; equal requests share one reply."""
    one = cache.groupBy("key").agg(F.min("reply").alias("reply"))
    return df.withColumn("key", cache_key(request)).join(one, "key", "left")


def support(df: DataFrame, reply: str = "reply") -> DataFrame:
    """(n_claims, n_unsupported, unsupported_rate) of a judge's replies; partly supported and unread ones count as unsupported."""
    bad = F.sum((parse_verdict(F.col(reply)) != "yes").cast("bigint"))
    return df.agg(F.count(F.lit(1)).alias("n_claims"), F.coalesce(bad, F.lit(0)).alias("n_unsupported"), F.round(F.try_divide(bad, F.count(F.lit(1))), 6).alias("unsupported_rate"))
