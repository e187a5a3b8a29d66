"""Entity keys and reports on their degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import id_string, norm_token

TYPES = ["uid", "device", "email", "addr", "card"]  # the order in which graphs take them


def card_keys(df: DataFrame) -> DataFrame:
    """Keys from raw card columns: uid, device, email, addr, card; null where their parts are missing."""
    i = {c: id_string(F.col(c)) for c in ("card1", "card2", "card3", "card5", "addr1", "addr2", "id_32")}
    origin = id_string(F.bround(F.col("day") - F.col("D1"), 0))
    device = [norm_token(F.col("DeviceInfo")), norm_token(F.col("id_30")), norm_token(F.col("id_31")), i["id_32"], norm_token(F.col("id_33"))]
    some = lambda parts: F.exists(F.array(*parts), lambda x: x != "NA")
    key = lambda sep, parts: F.when(some(parts), F.concat_ws(sep, *parts))
    uid = F.concat_ws("_", *[i[c] for c in ("card1", "card2", "card3", "card5", "addr1", "addr2")], origin)
    return df.withColumns({
        "uid_min": F.concat_ws("_", i["card1"], i["addr1"], origin), "uid": F.when(F.col("card1").isNotNull() | F.col("addr1").isNotNull(), uid),
        "device": key("|", device), "email": F.nullif(norm_token(F.col("P_emaildomain")), F.lit("NA")),
        "addr": key("_", [i["addr1"], i["addr2"]]), "card": key("_", [i["card1"], i["card2"]]),
    })


def long_form(df: DataFrame, types: list[str], keep: list[str]) -> DataFrame:
    """One row per entity value of a transaction, nulls left out."""
    return df.unpivot(keep, types, "etype", "value").filter("value IS NOT NULL")


def degrees(df: DataFrame, types: list[str] = TYPES) -> DataFrame:
    return long_form(df.select("txn_id", *types), types, ["txn_id"]).groupBy("etype", "value").agg(F.count(F.lit(1)).alias("degree"))


def report(df: DataFrame, cfg: Config, types: list[str] = TYPES) -> DataFrame:
    """Per type: coverage, distinct values, degree quantiles, and what degree pruning takes; types without values too."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    lost = F.when((F.col("degree") > cfg.max_degree) | (F.col("degree") < cfg.min_degree), F.col("degree")).otherwise(0)
    per = degrees(df, types).groupBy("etype").agg(
        F.sum("degree").alias("present"), F.count(F.lit(1)).alias("n_distinct"), F.expr("percentile(degree, 0.5)").alias("median_degree"),
        F.expr("percentile(degree, 0.99)").alias("p99_degree"), F.max("degree").alias("max_degree"),
        F.sum((F.col("degree") > cfg.max_degree).cast("bigint")).alias("n_values_over_cap"), F.sum(lost).alias("rows_losing"),
    )
    every = df.sparkSession.createDataFrame([(t,) for t in types], "etype string")
    out = every.join(per, "etype", "left").crossJoin(F.broadcast(rows))  # one row
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        "etype", F.round(z("present") * 100.0 / F.col("rows"), 4).alias("coverage_pct"), z("n_distinct").alias("n_distinct"), F.round(z("median_degree").cast("double"), 6).alias("median_degree"),
        F.round(z("p99_degree").cast("double"), 6).alias("p99_degree"), z("max_degree").alias("max_degree"), z("n_values_over_cap").alias("n_values_over_cap"),
        z("rows_losing").alias("rows_losing"), F.round(z("rows_losing") * 100.0 / F.col("rows"), 4).alias("losing_pct"),
    )
