"""Awkward rows that every operator on documents must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.LongType()),
    T.StructField("score", T.DoubleType()), T.StructField("ids", T.StringType()),
])


def rows():
    texts = [None, "", " \t\n", "a", "the quick brown fox jumps over the lazy dog.", "the quick brown fox jumps over the lazy dog.",
             "É ñ ß Σ ΟΔΟΣ İ 漢字 🎉 don't I'll <|endoftext|> x <|startoftext|>", "word " * 30_000, "z" * 50_000, "\x00\x1c\x85   b"]
    out = [(i, t, None if i % 3 else "en", "s", None, 7, 0.5, "x") for i, t in enumerate(texts)]
    return [*out, out[4], (None, "no id", None, None, None, None, None, None)]


def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def write(spark, tmp_path, df, name="documents"):
    """A folder of tables that a query can read."""
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
