"""Embedding near-duplicates through a pivot-permutation index.

Fitting: pivots are vectors of a bounded sample, in the order of a hash, that lie apart from each other; their number
grows with the root of the number of vectors, up to `most`. Indexing: every vector is described by its `near`
nearest pivots (its permutation's prefix). Inverted lists hold, for each label and each two pivots, the vectors with
both in their prefix, so the lists are as many as the vectors and stay short. Two vectors are a candidate pair if they share at
least two pivots; the count of shared pivots below the list's second one tells in which single list a pair is looked at.

1. Equal vectors of a label become one, with a number of copies.
2. The lists, without vectors, tell which members have a candidate in them at all.
3. Only those take their vectors to the list, and the cosines of candidate pairs are computed in double precision.

No list meets in one task: lists are cut into blocks of at most `block` vectors by a hash, and tasks take pairs of
blocks. A pair of blocks gives, for each vector, the number of its links and, by a union-find over its links, edges
that connect what the links connect; pairs themselves are never sent.

Recall is measured by tests against brute force on planted pairs of cosine 0.93 to 0.99.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do those with
a null label or of another length than the vector compared with; repeated rows (equal ids too) are vectors of their
own, each with its row; a null id stays null and counts as no smallest id unless its component has no other; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forest, forget, stored, table

_PAIRS = 1 << 16  # pairs looked at in one step


def fit(vectors: DataFrame, most: int = 8192, apart: float = 0.7) -> dict[int, np.ndarray]:
    """Pivots by vector length, from a sample of at most 4 * most. vectors: v (array<double>, unit length), size."""
    n = vectors.count()
    pivots = int(min(most, max(32, 8 * n**0.5)))
    sample = vectors.select("size", "v", F.xxhash64("v").alias("h")).orderBy("h").limit(4 * pivots).toPandas()
    out = {}
    for size, own in sample.groupby("size"):
        x = np.array(own["v"].tolist(), float)
        take = x[:1]
        for k in range(0, len(x), 256):
            some = x[k : k + 256]
            some = some[(some @ take.T).max(1) < apart]
            chosen: list[int] = []
            near = some @ some.T
            for i in range(len(some)):
                if not chosen or near[i, chosen].max() < apart:
                    chosen.append(i)
            take = np.concatenate([take, some[chosen]])
            if len(take) >= pivots:
                break
        out[int(size)] = take[:pivots]
    return out


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole lists, from batches sorted by list."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        names = t["list"].to_numpy()
        cut = int(np.searchsorted(names, names[-1]))  # the last list may go on
        if cut or (held and held[-1]["list"][-1].as_py() != names[-1]):
            yield pa.concat_tables([*held, t.slice(0, cut)]).combine_chunks()
            held, t = [], t.slice(cut)
        held.append(t)
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _candidates(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j) of one list and, of a pair of blocks, of both, that are looked at in this list."""
    names, block, q, kind = (t[x].to_numpy() for x in ("list", "block", "q", "kind"))
    near = t["near"].combine_chunks().flatten().to_numpy().reshape(len(names), -1)
    where = np.arange(len(names))
    first = np.searchsorted(names, names)  # each row meets the rows of its list before it
    ends = np.cumsum(where - first)
    lo = 0
    while lo < len(names):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PAIRS, "right")))
        n = (where - first)[lo:hi]
        j = np.repeat(where[lo:hi], n)
        i = first[j] + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)
        ok = ((t["cross"].to_numpy()[j] == 0) | (block[i] != block[j])) & (kind[i] == kind[j]) & (q[i] == q[j])  # lists are named by hashes
        i, j = i[ok], j[ok]
        a, b = near[i], near[j]
        shared = np.zeros(len(i), np.int8)
        for k in range(near.shape[1]):  # shared pivots below the list's second one: the first alone, or the pair is another list's
            own = a[:, k]
            shared += ((own >= 0) & (own < q[j])) & (b == own[:, None]).any(1)
        ok = shared == 1
        yield i[ok], j[ok]
        lo = hi


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members that have a candidate in their list."""
    for t in _whole_lists(batches):
        has = np.zeros(t.num_rows, bool)
        for i, j in _candidates(t):
            has[i] = has[j] = True
        yield from t.filter(pa.array(has)).to_batches()


def _verify(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_lists(batches):
            row, copies = t["row"].to_numpy(), t["copies"].to_numpy()
            values = t["v"].combine_chunks()
            at, flat = values.offsets.to_numpy(), values.values.to_numpy()
            links = np.zeros(len(row), np.int64)
            edges = []
            for i, j in _candidates(t):
                if not len(i):
                    continue
                good = np.zeros(len(i), bool)
                for k in range(0, len(i), 1 << 13):
                    x, y = i[k : k + (1 << 13)], j[k : k + (1 << 13)]
                    size = at[x + 1] - at[x]
                    for s in np.unique(size):  # lists hold vectors of one length
                        m = size == s
                        u, w = (flat[at[z[m], None] + np.arange(s)] for z in (x, y))
                        good[k : k + (1 << 13)][m] = np.einsum("nd,nd->n", u, w) >= cosine
                i, j = i[good], j[good]
                links += np.bincount(i, copies[j], len(row)).astype(np.int64) + np.bincount(j, copies[i], len(row)).astype(np.int64)
                edges.append((row[i], row[j]))
            hit = links > 0
            yield pa.record_batch({"row": row[hit], "n": links[hit], "b": pa.nulls(int(hit.sum()), pa.int64())})
            if edges:
                a, b = (np.concatenate(x) for x in zip(*edges, strict=True))
                for star in forest(iter([pa.record_batch({"u": a, "v": b})])):
                    yield pa.record_batch({"row": star["u"], "n": pa.nulls(star.num_rows, pa.int64()), "b": star["v"]})

    return run


def links(vectors: DataFrame, cosine: float = 0.93, near: int = 8, most: int = 8192, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(row, n_links) and edges (a, b) between rows. vectors: row, label, v, size, copies; unequal within a label."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(fit(vectors, most))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("size").to_numpy()
            out = np.full((b.num_rows, near), -1, np.int32)
            out[:, :2] = (0, 1)  # a length without two pivots has one list
            for s in np.unique(size):
                p = sent.value.get(int(s), [])
                if len(p) < 2:
                    continue
                k = min(near, len(p))
                at = np.flatnonzero(size == s)
                for lo in range(0, len(at), 1024):
                    some = at[lo : lo + 1024]
                    x = b.column("v").take(pa.array(some)).flatten().to_numpy().reshape(len(some), int(s)) @ p.T
                    out[some, :k] = np.sort(np.argpartition(-x, k - 1, axis=1)[:, :k], axis=1)
            yield pa.record_batch([b["row"], b["label"], b["size"], pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), near).cast(pa.list_(pa.int32()))], names=["row", "label", "size", "near"])

    indexed = stored(vectors.select("row", "label", "v", "size").mapInArrow(describe, "row long, label string, size int, near array<int>"))
    held = F.filter("near", lambda x: x >= 0)
    of = indexed.select("row", "label", "size", "near", F.explode(held).alias("p")).select("*", F.explode(F.filter(held, lambda x: x > F.col("p"))).alias("q"))
    of = of.withColumn("key", F.xxhash64("label", "size", "p", "q"))
    sizes = of.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    of = of.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    # block b meets every block: of (b, j) for j >= b and of (i, b) for i < b
    of = of.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "o"), F.greatest("block", "o")
    members = of.select(F.xxhash64("key", "size", "p", "q", low, high).alias("list"), "block", (F.col("block") != F.col("o")).cast("int").alias("cross"), "q", F.xxhash64("label", "size", F.lit(3)).alias("kind"), "row", "near")
    # the own block is in the list of each pair of blocks once only
    flagged = stored(members.repartition("list").sortWithinPartitions("list").mapInArrow(_flag, members.schema))
    asked = flagged.join(vectors.select("row", "v", "copies"), "row")
    found = stored(asked.repartition("list").sortWithinPartitions("list").mapInArrow(_verify(cosine), "row long, n long, b long"))
    forget(indexed, flagged)
    counted = found.filter("n IS NOT NULL").groupBy("row").agg(F.sum("n").alias("n_links"))
    return counted, found.filter("b IS NOT NULL").select(F.col("row").alias("a"), "b")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.93, **index: int) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row a vector. embeddings: vec_id, embedding, label."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True))
    rows = rows.withColumn("t", F.when(fine, F.array_max(F.transform("v", lambda x: F.abs(x)))))
    rows = rows.withColumn("v", F.when(F.col("t") > 0, F.transform("v", lambda x: x / F.col("t"))))
    rows = rows.withColumn("norm", norm).withColumn("v", F.transform("v", lambda x: x / F.col("norm")))
    # equal vectors of a label have equal hashes (128 bits); a vector that links with nothing has none
    own = [F.when(F.col("v").isNotNull(), F.xxhash64("label", "v", F.lit(k))).alias(f"g{k}") for k in (1, 2)]
    rows = stored(rows.select("row", "vec_id", "label", "v", *own))
    groups = rows.filter("v IS NOT NULL").groupBy("g1", "g2").agg(
        F.min("row").alias("row"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"),
    )
    groups = stored(groups.withColumn("size", F.size("v")))
    counted, edges = links(groups, cosine, **index)
    named = groups.select("g1", "g2", "row", "least", "copies").join(components(edges).withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = named.join(least, "root").join(counted, "row", "left").select("g1", "g2", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("known"))
    out = rows.select("vec_id", "g1", "g2").join(whole, ["g1", "g2"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def op3_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
