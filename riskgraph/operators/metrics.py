"""Metrics with exact treatment of ties; scores are counted first, so no window sees raw rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_score(df: DataFrame) -> DataFrame:
    """Positives and rows per distinct score, with running counts from the highest; a bounded table for rounded scores."""
    per = df.groupBy("score").agg(F.sum("label").alias("tp"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumns({"ctp": F.sum("tp").over(w), "cn": F.sum("n").over(w)})


def pr_auc(df: DataFrame) -> DataFrame:
    """Average precision: each distinct threshold's gain in recall times its precision."""
    return by_score(df).agg(F.round(F.try_divide(F.sum(F.col("tp") * F.col("ctp") / F.col("cn")), F.sum("tp")), 6).alias("pr_auc"))


def roc_auc(df: DataFrame) -> DataFrame:
    neg = F.col("n") - F.col("tp")
    area = F.sum(neg * (F.col("ctp") - F.col("tp") + F.col("tp") / 2.0))
    return by_score(df).agg(F.round(F.try_divide(area, (F.sum("tp") * F.sum(neg)).cast("double")), 6).alias("roc_auc"))


def recall_at_fpr(df: DataFrame, points: list[float], groups: list[str] | None = None) -> DataFrame:
    """Recall at the linear quantile 1 - f of the (group's own) negatives' scores; null if a class is missing."""
    groups = groups or []
    out = None
    for f in points:
        cut = df.filter("label = 0").groupBy(*groups).agg(F.expr(f"percentile(score, {1 - f})").alias("threshold"))
        both = df.join(cut, groups) if groups else df.crossJoin(F.broadcast(cut))  # one row
        hit = (F.col("score") >= F.col("threshold")).cast("double")
        got = both.groupBy(*groups).agg(F.lit(f).alias("fpr"), F.round(F.avg(F.when(F.col("label") == 1, hit)), 6).alias("recall"), F.count(F.lit(1)).alias("n"))
        out = got if out is None else out.unionByName(got)
    return out


def top_k(df: DataFrame, k: int, per_day: bool) -> DataFrame:
    if not per_day:
        return df.orderBy(F.desc("score"), "dt", "txn_id").limit(k)
    w = Window.partitionBy("day").orderBy(F.desc("score"), "dt", "txn_id")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def precision_at_k(df: DataFrame, k: int, per_day: bool = True) -> DataFrame:
    return top_k(df, k, per_day).agg(F.round(F.avg("label"), 6).alias("precision"), F.count(F.lit(1)).alias("n"))


def brier_logloss(df: DataFrame) -> DataFrame:
    p = F.greatest(F.least(F.col("score"), F.lit(1 - 1e-12)), F.lit(1e-12))
    loss = -(F.col("label") * F.log(p) + (1 - F.col("label")) * F.log(1 - p))
    return df.agg(F.round(F.avg((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))), 6).alias("brier"), F.round(F.avg(loss), 6).alias("log_loss"))


def ece_bins(df: DataFrame, bins: int = 15) -> DataFrame:
    """Left-closed equal bins with their gaps, empty ones too, and the calibration error over all."""
    edges = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    per = df.withColumn("bin", F.size(F.filter(edges, lambda e: e <= F.col("score")))).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("conf"), F.avg("label").alias("rate"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    whole = Window.partitionBy()
    out = every.join(per, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ece = F.sum(F.coalesce(F.abs(F.col("conf") - F.col("rate")) * F.col("n"), F.lit(0.0))).over(whole) / F.sum("n").over(whole)
    return out.select(F.col("bin").cast("bigint").alias("bin"), "n", F.round("conf", 6).alias("conf"), F.round("rate", 6).alias("rate"), F.round(ece, 6).alias("ece"))


def case_precision(df: DataFrame) -> DataFrame:
    """Share of flagged cases that hold a fraud; null if none is flagged."""
    good = F.sum((F.col("flagged") & (F.col("n_fraud") > 0)).cast("bigint"))
    return df.agg(F.round(F.try_divide(good, F.sum(F.col("flagged").cast("bigint"))), 6).alias("case_precision"))


def headline(df: DataFrame, name: str, k: int = 100) -> DataFrame:
    """One row with the headline metrics."""
    out = pr_auc(df).crossJoin(roc_auc(df)).crossJoin(brier_logloss(df)).crossJoin(precision_at_k(df, k).select("precision"))  # one row each
    recall = recall_at_fpr(df, [0.01]).select(F.col("recall").alias("recall_1pct"))
    return out.crossJoin(recall).withColumn("model", F.lit(name))


def amount_bands(df: DataFrame, n: int = 4) -> DataFrame:
    """Adds band: quantile bands of amt, closed on the right; equal edges fall together."""
    q = ", ".join(str(k / n) for k in range(n + 1))
    edges = df.agg(F.array_distinct(F.expr(f"percentile(amt, array({q}))")).alias("edges"))
    band = F.greatest(F.size(F.filter("edges", lambda e: e < F.col("amt"))), F.lit(1))
    return df.crossJoin(F.broadcast(edges)).withColumn("band", F.concat(F.lit("q"), band.cast("string"))).drop("edges")  # one row


def hour_bands(df: DataFrame) -> DataFrame:
    h = F.col("hour")
    return df.withColumn("band", F.when(h <= 6, "night").when(h <= 12, "morning").when(h <= 18, "afternoon").otherwise("evening"))


def psi(df: DataFrame, features: list[str], side: str, bins: int = 10) -> DataFrame:
    """(feature, psi): drift of side = 1 against side = 0 over the expected side's quantile bins, per feature."""
    long = df.unpivot([side], features, "feature", "x").filter("x IS NOT NULL AND NOT isnan(x)")
    q = ", ".join(str(k / bins) for k in range(bins + 1))
    edges = long.filter(F.col(side) == 0).groupBy("feature").agg(F.array_distinct(F.expr(f"percentile(x, array({q}))")).alias("edges"))
    # inner edges only: the ends are open
    inner = edges.withColumn("edges", F.expr("slice(edges, 2, greatest(size(edges) - 2, 0))"))
    cut = long.join(inner, "feature").withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("x"))))
    per = cut.groupBy("feature", "bin", F.size("edges").alias("inner")).agg(F.sum(F.when(F.col(side) == 0, 1).otherwise(0)).alias("e"), F.sum(F.when(F.col(side) == 1, 1).otherwise(0)).alias("a"))
    w = Window.partitionBy("feature")
    per = per.withColumns({"pe": F.col("e") / F.sum("e").over(w) + 1e-6, "pa": F.try_divide(F.col("a"), F.sum("a").over(w)) + 1e-6})
    empty = F.max("inner") + 1 - F.count(F.lit(1))  # bins that neither side fills add nothing
    value = F.sum((F.col("pa") - F.col("pe")) * F.log(F.col("pa") / F.col("pe"))) + 0 * empty
    return per.groupBy("feature").agg(F.round(value, 6).alias("psi"))


def device_bands(df: DataFrame) -> DataFrame:
    return df.withColumn("band", F.when(F.col("device").isNull(), "device_absent").otherwise("device_present"))


def freshness_bands(df: DataFrame) -> DataFrame:
    """new_uid for rows without an earlier row of their uid."""
    return df.withColumn("band", F.when(F.coalesce("uid_prior_count", F.lit(0)) <= 0, "new_uid").otherwise("returning_uid"))


def psi_report(df: DataFrame, features: list[str], side: str, limit: float = 0.25) -> DataFrame:
    """(feature, psi, flagged, rank), the largest drift first; equal ones by name."""
    w = Window.orderBy(F.desc("psi"), "feature")  # one row a feature
    return psi(df, features, side).withColumns({"flagged": F.col("psi") > limit, "rank": F.row_number().over(w)}).orderBy("rank")


def calibration_bundle(df: DataFrame, bins: int = 15) -> DataFrame:
    """One row: ece, brier and log_loss."""
    return ece_bins(df, bins).agg(F.max("ece").alias("ece")).crossJoin(brier_logloss(df))  # one row each
