"""Shared pieces: table reads, lineage cuts in the shared folder, vectorised word hashing, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WINDOW = 1 << 16
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: spark.checkpoint.dir. Only a local session may go without (a temporary one is made)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="riskgraph-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


#: Shuffle files go with the query that made them; workers get few texts at once.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}


#: Batches of short rows, and of texts up to the same bytes.
_SHORT = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16384", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def _tidy(spark: SparkSession, short: bool = False) -> Iterator[None]:
    want = {**_WHILE_WRITING, **_SHORT} if short else _WHILE_WRITING
    before = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def collected(df: DataFrame) -> pa.Table:
    """The rows of a table of bounded size, made of short rows; the shuffle files of what computed it go at once."""
    with _tidy(df.sparkSession, short=True):
        return df.toArrow()


def stored(df: DataFrame, narrow: bool = False, short: bool = False) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts lineage, survives lost executors.

    The shuffle files of what computed it go once it is written; the table itself goes when forgotten or when the
    application ends. narrow: for tables of a few short columns, at most eight tasks a core write it, so that it has
    few small files. short: workers read tables of short rows, so batches end by bytes.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(8 * max(1, spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark)}/riskgraph-{uuid.uuid4().hex}"
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    with _tidy(spark, short):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._riskgraph_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        fs, at = _path(t.sparkSession, t._riskgraph_path)
        fs.delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in upper or lower case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def large_binary_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying values; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    n, off = len(col), np.frombuffer(col.buffers()[1], dtype=np.int64)
    off = off[col.offset : col.offset + n + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]] if n else data[:0], (off - off[0]) if n else np.zeros(1, np.int64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_R = 0x9E3779B97F4A7C15 | 1


def _tables(fold: bool) -> np.ndarray:
    t = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
    if fold:
        t[65:91] = t[97:123]
    return t


_TABLE = {False: _tables(False), True: _tables(True)}
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get("up")
    if have is None or len(have) < n:
        for k, v in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            a = np.full(max(n, _WINDOW + 1), v, dtype=np.uint64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's steps) over uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^ \\t-\\r]+ of several texts, and each text's first word index (n + 1 values).

    A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums, so the cost is a few
    vector operations a byte. fold: A-Z count as a-z. Work goes in windows cut at white space: memory is bounded.
    """
    size = len(data)
    first = np.zeros(size + 1, bool)
    first[offsets[:-1]] = True
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:size]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:size]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    out = np.empty(len(starts), np.uint64)
    t, k = _TABLE[fold], 0
    while k < len(starts):
        lo = starts[k]
        e = max(int(np.searchsorted(stops, lo + _WINDOW, "right")), k + 1)
        hi = stops[e - 1]
        up, down = _powers(int(hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(t[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        a, b = starts[k:e] - lo, stops[k:e] - lo
        out[k:e] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        k = e
    return out, np.searchsorted(starts, offsets)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a worker holds stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def trim() -> None:
    """Gives the system what this worker has freed. Workers are used again, and allocators keep a stage's largest need for the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def forest(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Stars around the smallest nodes that join what every `most` edges (u, v) join: never more edges than come in."""
    root: dict = {}
    held = 0

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def stars(schema: pa.Schema) -> pa.RecordBatch:
        edges = [(u, c) for u in list(root) if (c := find(u)) != u]
        columns = [pa.array([e[k] for e in edges], schema.field(name).type) for k, name in enumerate(("u", "v"))]
        root.clear()
        return pa.record_batch(columns, names=["u", "v"])

    schema = None
    for b in batches:
        schema = b.schema
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                root[max(u, v)] = min(u, v)
        held += b.num_rows
        if held >= most:
            held = 0
            yield stars(schema)
    if root:
        yield stars(schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges, for every node of an edge.

    Each task's edges shrink to a forest of stars, and large-star and small-star steps alternate (Kiveris et al.
    2014) until all edges are stars. Each edge list is written to the shared folder, so lineage stays short, and stars
    never gather a node's neighbours in one row.
    """

    def kept(pairs: DataFrame) -> DataFrame:
        pairs = pairs.filter("u <> v")
        return stored(pairs.mapInArrow(forest, pairs.schema).distinct(), narrow=True)

    cur = kept(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while True:
        # stars: no node is both an end and a centre, none is the end of two edges
        part = cur.select(F.col("u").alias("n"), F.lit(1).alias("ends"), F.lit(0).alias("centre"))
        part = part.unionByName(cur.select(F.col("v").alias("n"), F.lit(0).alias("ends"), F.lit(1).alias("centre")))
        part = part.groupBy("n").agg(F.sum("ends").alias("ends"), F.max("centre").alias("centre"))
        if not part.filter("ends + centre > 1 AND ends > 0").agg(F.count(F.lit(1))).first()[0]:
            break
        # large-star: larger neighbours of each node go to the smallest neighbour (or itself)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: smaller neighbours and the node itself go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, cur = cur, kept(small.unionByName(low.select("u", F.col("m").alias("v"))))
        forget(old)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
