"""Base features and encoders that are fitted on the train split only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def amount_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"amount": F.col("amt"), "log_amount": F.log1p("amt"), "cents": F.col("amt") - F.floor("amt")})


def missingness(df: DataFrame, columns: list[str], flagged: list[str]) -> DataFrame:
    """identity_present, identity_n_missing over columns, and a flag for each column in flagged."""
    missing = [F.col(c).isNull().cast("bigint") for c in columns]
    total = missing[0]
    for m in missing[1:]:
        total = total + m
    return df.withColumns({"identity_n_missing": total, "identity_present": (total < len(columns)).cast("bigint"), **{f"{c}_missing": F.col(c).isNull().cast("bigint") for c in flagged}})


def fit_frequency(train: DataFrame, column: str) -> DataFrame:
    """(value, freq): shares among non-null values of the train split."""
    per = train.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select(column, (F.col("n") / F.col("total")).alias("freq"))  # one row


def encode_frequency(df: DataFrame, freq: DataFrame, column: str) -> DataFrame:
    return df.join(freq, column, "left").withColumn(f"{column}_freq", F.coalesce("freq", F.lit(0.0))).drop("freq")


def correlations(df: DataFrame, columns: list[str], chunk: int = 1000) -> DataFrame:
    """(a, b, r): absolute Pearson correlations, rows with either value null left out; one pass for each chunk of pairs.

    r is null without such rows, and NaN where either column doesn't vary in them (corr would raise in ANSI mode)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = None
    for k in range(0, len(pairs), chunk):
        part = pairs[k : k + chunk]
        one = df.agg(*[_correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(part)])
        got = one.selectExpr(f"stack({len(part)}, " + ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(part)) + ") AS (a, b, r)")
        out = got if out is None else out.unionByName(got)
    return out


def _correlation(a: str, b: str) -> Column:
    xx, yy, xy = F.regr_sxx(b, a), F.regr_syy(b, a), F.regr_sxy(b, a)
    return F.when(xx.isNull() | ((xx > 0) & (yy > 0)), F.abs(F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy)))).otherwise(F.lit(float("nan")))


def correlation_prune(df: DataFrame, columns: list[str], limit: float = 0.95) -> list[str]:
    """Columns kept, best covered first (ties: given order); one that correlates above limit with a kept one goes.

    A null or NaN correlation is none."""
    cover = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    order = sorted(columns, key=lambda c: (-cover[c], columns.index(c)))
    r = {frozenset((x.a, x.b)): x.r for x in correlations(df, columns).collect()}
    kept: list[str] = []
    for c in order:
        if not any((r[frozenset((c, k))] or 0.0) > limit for k in kept):
            kept.append(c)
    return kept


def sample(df: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """At most n rows, the same for a seed, whatever the partitions."""
    return df.orderBy(F.xxhash64("txn_id", F.lit(seed)), "txn_id").limit(n)


def most_recent(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The key's last row by time."""
    at = F.struct("dt", "txn_id")
    return df.groupBy(key).agg(*[F.max_by(c, at).alias(c) for c in columns])


def mode_by_priority(long: DataFrame, order: list[str]) -> DataFrame:
    """(comp, etype, value, n): of the first type with any value, the most frequent (ties: smallest)."""
    rank = F.element_at(F.create_map(*[x for k, t in enumerate(order) for x in (F.lit(t), F.lit(k))]), F.col("etype"))
    per = long.groupBy("comp", "etype", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("comp").orderBy(rank, F.desc("n"), "value")
    return per.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def pass_through(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """txn_id with numbers as doubles and categories as texts; null stays null."""
    return df.select("txn_id", *[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(c).cast("string").alias(c) for c in categorical])


def categorical_columns(df: DataFrame, leave_out: tuple[str, ...] = ()) -> list[str]:
    """The text columns, in order."""
    return [c for c, t in df.dtypes if t == "string" and c not in leave_out]


def train_prior(df: DataFrame) -> DataFrame:
    """The mean label of the train split alone; null without a labelled row."""
    return df.filter("split = 'train'").agg(F.round(F.avg("label"), 6).alias("prior"))
