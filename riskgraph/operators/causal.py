"""Strictly-prior aggregates by RANGE frames: rows of the same second never see each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import NO_PRIOR, smoothed_rate, variation


class Frames:
    """Frames over integer seconds within a key. Counts in [t - w, t) are differences of growing counts, which
    Spark computes in one pass, where a sliding frame is summed anew for each row."""

    def __init__(self, keys: list[str], lag_seconds: int):
        w = Window.partitionBy(*keys).orderBy("dt")
        self.prior = w.rangeBetween(Window.unboundedPreceding, -1)
        self.mature = w.rangeBetween(Window.unboundedPreceding, -lag_seconds)
        self.before = lambda s: w.rangeBetween(Window.unboundedPreceding, -s - 1)

    def count_since(self, seconds: int, what: Column | None = None) -> Column:
        what = F.lit(1) if what is None else what
        return F.count(what).over(self.prior) - F.count(what).over(self.before(seconds))


def entity_features(df: DataFrame, key: str, prefix: str, train_prior: float, cfg: Config, lag_seconds: int | None = None) -> DataFrame:
    """Adds the key's aggregates over strictly earlier rows; rows without a key get the defaults."""
    lag = cfg.label_lag_days * 86400 if lag_seconds is None else lag_seconds
    f = Frames([key], lag)
    n, total, squares = F.count(F.lit(1)).over(f.prior), F.sum("amt").over(f.prior), F.sum(F.col("amt") * F.col("amt")).over(f.prior)
    known = F.col(key).isNotNull()
    none = F.lit(NO_PRIOR)
    hits, labelled = F.coalesce(F.sum("label").over(f.mature), F.lit(0)), F.count("label").over(f.mature)
    out = {
        "prior_count": (n, F.lit(0)), "prior_amt_mean": (F.coalesce(F.avg("amt").over(f.prior), none), none),
        "prior_amt_cv": (F.coalesce(variation(n, total, squares), none), none),
        "age_hours": (F.coalesce((F.col("dt") - F.min("dt").over(f.prior)) / 3600.0, none), none),
        "prior_n_labeled": (labelled, F.lit(0)), "prior_fraud_rate": (smoothed_rate(hits, labelled, train_prior, cfg.smoothing), F.lit(train_prior)),
        "max_contrib_dt": (F.coalesce(F.max("dt").over(f.prior), F.lit(-1)), F.lit(-1)),
        "label_max_contrib_dt": (F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("dt"))).over(f.mature), F.lit(-1)), F.lit(-1)),
    }
    for s in cfg.velocity_windows:
        name = f"velocity_{s // 3600}h" if s % 3600 == 0 else f"velocity_{s}s"
        out[name] = (f.count_since(s), F.lit(0))
    return df.withColumns({f"{prefix}_{k}": F.when(known, v).otherwise(d) for k, (v, d) in out.items()})


def violations(df: DataFrame, lag_seconds: int) -> DataFrame:
    """Counts of rows whose proof columns reach their own second, or labels that weren't mature. No proof column: an error."""
    proofs = [c for c in df.columns if c.endswith("max_contrib_dt")]
    if not proofs:
        raise ValueError("no *_max_contrib_dt column: nothing proves that aggregates are strictly prior")
    late = [c for c in proofs if c.endswith("label_max_contrib_dt")]
    plain = [c for c in proofs if c not in late]
    any_of = lambda cs: F.exists(F.array(*cs), lambda x: x) if cs else F.lit(False)
    return df.agg(
        F.sum(any_of([F.col(c) >= F.col("dt") for c in plain]).cast("bigint")).alias("not_prior"),
        F.sum(any_of([(F.col(c) >= 0) & (F.col(c) + lag_seconds > F.col("dt")) for c in late]).cast("bigint")).alias("not_mature"),
    )


def assert_causal(df: DataFrame, lag_seconds: int) -> None:
    r = violations(df, lag_seconds).first()
    if r.not_prior or r.not_mature:
        raise AssertionError(f"{r.not_prior} rows see their own second or later, {r.not_mature} see labels too early")


def drop_proofs(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith("max_contrib_dt")])
