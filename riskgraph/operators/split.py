"""Temporal split with an embargo, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config


def positions(df: DataFrame) -> DataFrame:
    """Adds pos, the row's place by (dt, txn_id): ranks within days, and running counts of days."""
    per = df.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("day", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy("dt", "txn_id")) - 1
    return df.join(per, "day").withColumn("pos", (F.col("before") + rank).cast("bigint")).drop("before")


def temporal_split(df: DataFrame, cfg: Config) -> DataFrame:
    """Adds split: train, val, test, or embargo for rows of a later side within the embargo of its first second."""
    bad = df.filter("dt IS NULL OR dt < 0").limit(1).count()
    if bad:
        raise ValueError("dt must be present and not negative")
    n = df.count()
    i1, i2 = round(n * cfg.train_share), round(n * cfg.val_share)
    at = positions(df)
    edges = at.agg(F.min(F.when(F.col("pos") == i1, F.col("dt"))).alias("b1"), F.min(F.when(F.col("pos") == i2, F.col("dt"))).alias("b2"))
    late = lambda b: F.col("dt") < F.col(b) + cfg.embargo_seconds
    split = (
        F.when(F.col("pos") < i1, "train").when((F.col("pos") < i2) & late("b1"), "embargo").when(F.col("pos") < i2, "val")
        .when(late("b2"), "embargo").otherwise("test")
    )
    return at.crossJoin(F.broadcast(edges)).withColumn("split", split).drop("b1", "b2")  # one row


def boundaries(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"), F.sum("label").alias("positives"))


def assert_ordered(df: DataFrame) -> None:
    """Each split lies strictly after the one before it."""
    got = {r.split: r for r in boundaries(df).collect()}
    order = [got[s] for s in ("train", "val", "test") if s in got]
    for a, b in zip(order, order[1:], strict=False):
        if a.max_dt >= b.min_dt:
            raise AssertionError(f"{a.split} reaches {a.max_dt}, {b.split} starts at {b.min_dt}")


def shuffled_labels(df: DataFrame, seed: int) -> DataFrame:
    """The same labels dealt to other rows, as a negative control: row k gets the label of row k in a hash's order."""
    salt = F.xxhash64("txn_id", F.lit(seed))
    keyed = df.withColumn("day", F.pmod(salt, F.lit(1024))).withColumn("dt", salt)
    other = positions(keyed.select("day", "dt", "txn_id", "label")).select("pos", F.col("label").alias("dealt"))
    return positions(df).join(other, "pos").withColumn("label", F.col("dealt")).drop("dealt", "pos")
