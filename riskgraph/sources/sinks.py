"""Sinks and their sources: features with metadata, the case queue, the JSONL ledger, report files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators import ledger
from .tables import markdown_table


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file through the cluster's own file system."""
    fs, at = _file(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_features(df: DataFrame, folder: str, labels: list[str] = ("label",), **facts: object) -> None:
    """features.parquet and meta.json: columns, their types, which are categorical, and what else is told."""
    df.write.mode("overwrite").parquet(f"{folder}/features.parquet")
    types = dict(df.dtypes)
    meta = {"columns": df.columns, "types": types, "categorical": [c for c, t in types.items() if t == "string"], "labels": list(labels), **facts}
    write_text(df.sparkSession, f"{folder}/meta.json", json.dumps(meta, sort_keys=True))


def read_features(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/features.parquet"), json.loads(spark.read.text(f"{folder}/meta.json", wholetext=True).first()[0])


def write_queue(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").json(path)


def read_queue(spark: SparkSession, path: str, schema: StructType | str, fallback: DataFrame | None = None) -> DataFrame:
    """The stored queue, or the fallback (a demo) where none is stored."""
    fs, at = _file(spark, path)
    if not fs.exists(at) and fallback is not None:
        return fallback
    return spark.read.schema(schema).json(path)


def case(cases: DataFrame, case_id: object, key: str = "comp") -> DataFrame:
    return cases.filter(cases[key] == case_id)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(seq, entry, prev_hash, hash): entry is the line as written."""
    return ledger.parsed(spark.read.text(path))


def append_ledger(df: DataFrame, path: str) -> None:
    """Appends entries (seq rising beyond those there) under a lock file: one writer at a time, others get an error.

    The caller's prev_hash is replaced. The lock is the file system's own atomic creation.
    """
    spark = df.sparkSession
    fs, lock = _file(spark, f"{path.rstrip('/')}.lock")
    if not fs.createNewFile(lock):
        raise RuntimeError(f"{path} is being written: {lock} exists")
    try:
        prev, last = ledger.GENESIS, None
        if fs.exists(_file(spark, path)[1]):
            tail = read_ledger(spark, path).selectExpr("max(seq) AS seq", "max_by(hash, seq) AS hash").first()
            if tail.hash:
                prev, last = tail.hash, tail.seq
        if last is not None and df.filter(df["seq"] <= last).limit(1).count():
            raise ValueError(f"seq must rise beyond {last}")
        ledger.chained(df, prev).select("entry").write.mode("append").text(path)
    finally:
        fs.delete(lock, False)


def write_reports(folder: str, reports: dict[str, tuple[str, DataFrame]]) -> None:
    """name.md for each report: its title and a table of at most 100 rows."""
    for name, (title, df) in reports.items():
        write_text(df.sparkSession, f"{folder}/{name}.md", f"# {title}\n\n{markdown_table(df)}\n")


