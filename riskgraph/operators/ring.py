"""Component features over strictly earlier members and attached rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import NO_PRIOR, entropy, fano, smoothed_rate, variation
from .causal import Frames

_KEYS = ["d", "comp"]


def ring_features(rows: DataFrame, train_prior: float, cfg: Config) -> DataFrame:
    """Features of today's rows. rows: d, comp, role, txn_id, dt, hour, amt, label, uid, device, addr, card."""
    f = Frames(_KEYS, cfg.label_lag_days * 86400)
    kinds = ["uid", "device", "addr", "card"]
    # a value's first row in the component carries a flag: distinct counts become sums of flags
    for t in kinds:
        first = F.row_number().over(Window.partitionBy(*_KEYS, t).orderBy("dt", "txn_id")) == 1
        rows = rows.withColumn(f"first_{t}", (first & F.col(t).isNotNull()).cast("bigint"))
    gap = F.col("dt") - F.lag("dt").over(Window.partitionBy(*_KEYS).orderBy("dt", "txn_id"))
    rows = rows.withColumn("gap", gap)
    over = lambda c: F.coalesce(F.sum(c).over(f.prior), F.lit(0))
    none = lambda c: F.coalesce(c, F.lit(NO_PRIOR))
    n = F.count(F.lit(1)).over(f.prior)
    flags = F.col("first_uid") + F.col("first_device") + F.col("first_addr") + F.col("first_card")
    fresh = over(flags) - F.coalesce(F.sum(flags).over(f.before(86400)), F.lit(0))
    gaps = F.count("gap").over(f.prior)
    ratio = lambda a, b: F.when(over(b) > 0, over(a) / over(b)).otherwise(F.lit(NO_PRIOR))
    hits, labelled = F.coalesce(F.sum("label").over(f.mature), F.lit(0)), F.count("label").over(f.mature)
    hours = [F.count(F.when(F.col("hour") == h, 1)).over(f.prior) for h in range(24)]
    out = {
        "comp_size": n, "comp_n_uid": over("first_uid"), "comp_n_device": over("first_device"), "comp_uid_per_device": ratio("first_uid", "first_device"),
        "comp_addr_per_card": ratio("first_addr", "first_card"), "comp_velocity_1h": f.count_since(3600), "comp_velocity_24h": f.count_since(86400),
        "comp_age_hours": none((F.col("dt") - F.min("dt").over(f.prior)) / 3600.0), "comp_amt_mean": none(F.avg("amt").over(f.prior)),
        "comp_amt_cv": none(variation(n, F.sum("amt").over(f.prior), F.sum(F.col("amt") * F.col("amt")).over(f.prior))),
        "comp_amt_small_share": none(F.avg((F.col("amt") < cfg.small_amount).cast("double")).over(f.prior)),
        "comp_new_entity_ratio": F.when(over(flags) > 0, fresh / over(flags)).otherwise(F.lit(NO_PRIOR)),
        "comp_burstiness": none(fano(gaps, F.sum("gap").over(f.prior), F.sum(F.col("gap").cast("double") * F.col("gap")).over(f.prior))),
        "comp_hour_entropy": none(entropy(hours, n)), "comp_prior_n_labeled": labelled, "comp_prior_fraud_rate": smoothed_rate(hits, labelled, train_prior, cfg.smoothing),
        "comp_max_contrib_dt": F.coalesce(F.max("dt").over(f.prior), F.lit(-1)),
        "comp_label_max_contrib_dt": F.coalesce(F.max(F.when(F.col("label").isNotNull(), F.col("dt"))).over(f.mature), F.lit(-1)),
    }
    return rows.withColumns(out).filter("role = 'today'").select("d", "comp", "txn_id", "dt", *out)


DEFAULTS = {
    "comp_size": 0, "comp_n_uid": 0, "comp_n_device": 0, "comp_velocity_1h": 0, "comp_velocity_24h": 0, "comp_prior_n_labeled": 0,
    "comp_max_contrib_dt": -1, "comp_label_max_contrib_dt": -1,
}


def with_defaults(df: DataFrame, ring: DataFrame, train_prior: float) -> DataFrame:
    """All rows: those that found no component get the defaults and comp_id -1."""
    cols = [c for c in ring.columns if c.startswith("comp_")]
    fill = lambda c: F.coalesce(F.col(c), F.lit(train_prior if c == "comp_prior_fraud_rate" else DEFAULTS.get(c, NO_PRIOR)))
    return df.join(ring.select("txn_id", F.col("comp").alias("_comp"), *cols), "txn_id", "left").withColumns({c: fill(c) for c in cols}).withColumn("comp_id", F.coalesce("_comp", F.lit(-1))).drop("_comp")
