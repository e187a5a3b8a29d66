"""Sources and sinks: typed readers, the canonical transaction contract, checksums, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200  # 2024-01-01 UTC, the zero of dt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_raw(spark: SparkSession, transactions: str, identity: str, schema: str, identity_schema: str, nrows: int | None = None) -> DataFrame:
    """CSV pair joined on txn_id (left); hyphens in the identity file's names become underscores."""
    tx = spark.read.csv(transactions, header=True, schema=schema)
    ident = spark.read.csv(identity, header=True, schema=identity_schema)
    ident = ident.toDF(*[c.replace("-", "_") for c in ident.columns])
    return (tx.limit(nrows) if nrows else tx).join(ident, "txn_id", "left")


def require(spark: SparkSession, path: str) -> str:
    """The path, or an error that says which input is missing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"{path} is missing: put the raw transaction and identity files there first")
    return path


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file below a folder, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256")).orderBy("file")


def time_parts(df: DataFrame) -> DataFrame:
    """day, hour and day_of_week from dt seconds. Rows are ordered by (dt, txn_id) wherever order counts; nothing is sorted here."""
    day = F.floor(F.col("dt") / 86400)
    return df.withColumns({"day": day, "hour": F.pmod(F.floor(F.col("dt") / 3600), F.lit(24)), "day_of_week": F.pmod(day, F.lit(7))})


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events joined with customer as canonical transactions."""
    ev, cu = read(spark, sf_dir, "events"), read(spark, sf_dir, "customer")
    k = F.get_json_object("props", "$.k")
    tx = ev.join(cu, ev.user_id == cu.c_custkey).select(
        F.col("event_id").alias("txn_id"), (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000) - EPOCH).alias("dt"), F.col("value").alias("amt"),
        (F.col("event_type") == "error").cast("bigint").alias("label"), F.col("event_type"), F.col("user_id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), k.alias("k"),
    )
    s = lambda c: F.col(c).cast("string")
    return time_parts(tx).withColumns({
        "uid": F.concat_ws("_", s("user_id"), s("nation")), "device": F.concat_ws("|", "k", s("hour")), "card": F.concat_ws("_", s("user_id"), "k"),
        "addr": F.concat_ws("_", s("nation"), "segment"), "email": F.col("segment"),
    })


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: present, coverage_pct, n_distinct, in one pass."""
    n = F.count(F.lit(1))
    one = df.agg(*[F.struct(F.count(c).alias("present"), F.round(F.count(c) * 100.0 / n, 2).alias("pct"), F.countDistinct(c).alias("d")).alias(c) for c in columns])
    parts = ", ".join(f"'{c}', {c}.present, {c}.pct, {c}.d" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {parts}) AS (column_name, present, coverage_pct, n_distinct)")


def summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").alias("positives"), F.round(F.avg("label"), 6).alias("base_rate"),
        F.min("day").alias("min_day"), F.max("day").alias("max_day"), F.min("dt").alias("min_dt"), F.max("dt").alias("max_dt"),
    )


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """A report table of at most `limit` rows: null as nothing, NaN as n/a, floats with four places."""

    def cell(x: object) -> str:
        if x is None:
            return ""
        if isinstance(x, float):
            return "n/a" if x != x else f"{x:.4f}"
        return str(x)

    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])
