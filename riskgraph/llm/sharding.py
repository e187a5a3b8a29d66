"""Balanced label propagation: linked documents move towards their neighbours' shards under capacity quotas.

1. Each linked document starts in the shard that its own row hashes to.
2. In each round a join brings the neighbours' shards to every linked document. A neighbour's vote counts as much as it
   has links (a little more if its row is smaller), and so does a document's own vote for where it is: followers go to
   hubs, hubs don't run after them, and of two alike the larger row moves, so nobody swaps for ever. Documents ask to
   move where most votes are, and a shard admits askers, cluster by cluster, up to its free quota. Rounds end when
   nobody asks or nobody is admitted, or after `rounds`.
3. Documents that a full shard has turned away, and those beyond a shard's quota (of large clusters first), are laid
   side by side into the emptiest shards in whole runs, so that a cluster larger than a quota is cut in few parts.
   A document's cluster is the smallest row within two links of it.
4. Documents without links fill the shards to one level, large ones first by size classes of a factor of four; each class
   evens out what the one before left, so that sizes differ by about the smallest class's largest document.

Quotas, fills and slots need running sums over all documents. They are taken in two steps: sums of buckets (about
four times the root of the number of rows), running sums over that small table, then within each bucket. No
task reads a shard or a group as a whole. All of it is DataFrame code; the driver sees one number per shard.

Cases: a null text has 8 bytes, checksum 0, and is equal to the empty text; a null or repeated doc_id is as good as any:
each row is placed by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, stored, table


def running(df: DataFrame, group: Sequence[str], bucket: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of value over the rows before (by bucket, then order; order must be total), within group."""
    df = df.withColumn("_value", value)
    totals = df.groupBy(*group, *bucket).agg(F.sum("_value").alias("_sum"))
    w = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, *bucket, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*group, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(totals, [*group, *bucket])
    return out.withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(w), F.lit(0))).drop("_value", "_before")


def propagate(nodes: DataFrame, links: DataFrame, shards: int, quota: float, rounds: int, trace: list | None = None) -> DataFrame:
    """(row, size, shard, cluster, denied) of the linked nodes. nodes: row, size; links: a, b (rows).

    trace receives the numbers of askers and of admitted ones of each round.
    """
    both = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    own = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select(F.col("u").alias("row"), F.least("u", "m").alias("near"), "degree")
    own = stored(own)
    far = both.join(own.select(F.col("row").alias("v"), "near"), "v").groupBy("u").agg(F.min("near").alias("cluster"))
    start = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    now = own.join(far.withColumnRenamed("u", "row"), "row").join(nodes, "row")
    now = stored(now.select("row", "size", start, F.least("near", "cluster").alias("cluster"), "degree", (F.col("near") == F.col("row")).alias("first"), F.lit(False).alias("denied")))
    forget(own)
    for _ in range(rounds):
        said = both.join(now.select(F.col("row").alias("v"), "shard", "degree"), "v").select("u", "shard", (F.col("degree") + F.when(F.col("v") < F.col("u"), 0.5).otherwise(0.0)).alias("w"))
        said = said.unionByName(now.select(F.col("row").alias("u"), "shard", (F.col("degree") + F.when(F.col("first"), 0.5).otherwise(0.0)).alias("w")))
        votes = said.groupBy("u", "shard").agg(F.sum("w").alias("w"))
        best = votes.groupBy("u").agg(F.max(F.struct("w", (-F.col("shard")).alias("s"))).alias("b")).select(F.col("u").alias("row"), (-F.col("b.s")).alias("to"))
        by = [F.pmod(F.xxhash64("cluster"), F.lit(256)).alias("of"), F.pmod(F.xxhash64("row"), F.lit(64)).alias("part")]
        ask = stored(now.join(best, "row").filter(F.col("to") != F.col("shard")).select("row", "size", "to", *by))
        load = now.groupBy(F.col("shard").alias("to")).agg(F.sum("size").alias("load"))
        w = Window.partitionBy("to").orderBy("of", "part")
        parts = ask.groupBy("to", "of", "part").agg(F.sum("size").alias("s")).withColumn("upto", F.sum("s").over(w)).join(load, "to", "left")
        admit = parts.select("to", "of", "part", (F.coalesce("load", F.lit(0)) + F.col("upto") <= quota).alias("fits"))
        told = stored(ask.join(F.broadcast(admit), ["to", "of", "part"]).select("row", "to", "fits"))  # at most shards x 256 x 64 rows
        asked, admitted = told.agg(F.count(F.lit(1)), F.count_if("fits")).first()
        if trace is not None:
            trace.append((asked, admitted))
        shard = F.when(F.col("fits"), F.col("to")).otherwise(F.col("shard")).alias("shard")
        new = stored(now.join(told, "row", "left").select("row", "size", shard, "cluster", "degree", "first", F.coalesce(~F.col("fits"), F.lit(False)).alias("denied")))
        forget(now, ask, told)
        now = new
        if not admitted:
            break
    forget(both)
    return now


def _levels(loads: list[float], more: float) -> list[float]:
    """What each shard takes so that `more` raises the lowest loads to one level."""
    order = sorted(loads)
    level = order[0]
    for k in range(1, len(order) + 1):
        level = (more + sum(order[:k])) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - x) for x in loads]


def _fill(pool: DataFrame, loads: list[float], bucket: Sequence[str], order: Sequence[str], quota: float | None = None) -> DataFrame | None:
    """Places the pool's rows (row, size, ...) by running size into the shards' gaps, the widest gap first.

    Gaps reach up to quota, or else to the level that the pool brings the lowest shards to.
    """
    total = pool.agg(F.sum("size")).first()[0]
    if not total:
        return None
    room = _levels(loads, total) if quota is None else [quota - x for x in loads]
    gaps = sorted(((g, s) for s, g in enumerate(room) if g > 0), reverse=True)
    ends, at = [], 0.0
    for g, _ in gaps:
        ends.append(at := at + g)
    run = running(pool, [], bucket, order, F.col("size"), "at")
    middle = F.col("at") + F.col("size") / 2
    place = F.size(F.filter(F.array(*[F.lit(float(x)) for x in ends[:-1]]), lambda x: x <= middle)) if len(ends) > 1 else F.lit(0)
    shard = F.element_at(F.array(*[F.lit(s) for _, s in gaps]), place + 1)
    out = stored(run.select("row", shard.cast("int").alias("shard"), "size"))
    for s, x in out.groupBy("shard").agg(F.sum("size")).collect():
        loads[s] += x
    return out.select("row", "shard")


def place(nodes: DataFrame, links: DataFrame, shards: int = 24, rounds: int = 6, trace: list | None = None) -> DataFrame:
    """(row, shard): every node, byte sizes nearly equal. nodes: row (unique), size (>= 1); links: a, b."""
    n, total, largest = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.max("size")).first()
    if not n:
        return nodes.select("row", F.lit(0).alias("shard")).limit(0)
    quota, parts = total / shards, 4 * int(n**0.5) + 1
    linked = propagate(nodes, links, shards, quota, rounds, trace)
    by_hash = F.pmod(F.xxhash64("row"), F.lit(parts))

    def held(rows: DataFrame) -> list[float]:
        loads = [0.0] * shards
        for s, x in rows.groupBy("shard").agg(F.sum("size")).collect():
            loads[s] = float(x)
        return loads

    out, pool = [], None
    loads = held(linked)
    if max(loads) > quota or linked.filter("denied").take(1):
        # small clusters keep their place; a large cluster's rows are spread over buckets by a hash. There are at most
        # n / per large ones, about four times the root of n
        per = max(1, n // parts)
        big = linked.groupBy("cluster").agg(F.sum("size").alias("whole"), F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > per)
        run = linked.join(F.broadcast(big), "cluster", "left").withColumn("rank", F.coalesce(F.floor(F.log2("whole")), F.lit(0)))
        run = run.withColumn("near", F.when(F.col("rows").isNotNull(), F.xxhash64("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(parts))))
        run = stored(run.withColumn("part", F.when(F.col("rows").isNotNull(), F.pmod(F.xxhash64("row"), F.ceil(F.col("rows") / per))).otherwise(0)))
        keys = ["rank", "near", "part"]
        stay = stored(running(run.filter("not denied"), ["shard"], keys, ["cluster", "row"], F.col("size"), "at"))
        keep = F.col("at") + F.col("size") <= quota
        linked, over = stay.filter(keep), stay.filter(~keep).drop("at")
        pool = over.unionByName(run.filter("denied"))
        loads = held(linked)
    out.append(linked.select("row", "shard"))
    if pool is not None:
        out.append(_fill(pool, loads, ["rank", "near", "part"], ["cluster", "row"], quota))
    free = nodes.join(linked.select("row") if pool is None else linked.select("row").unionByName(pool.select("row")), "row", "left_anti")
    free = stored(free.withColumn("part", by_hash))
    high = float(largest) + 1
    while high > 1:
        low = high / 4
        if high < max(64.0, quota / 4096):
            low = 0.0
        out.append(_fill(free.filter((F.col("size") < high) & (F.col("size") >= low)), loads, ["part"], ["row"]))
        high = low
    placed = [x for x in out if x is not None]
    whole = placed[0]
    for x in placed[1:]:
        whole = whole.unionByName(x)
    return whole


def slots(placed: DataFrame, n: int, shards: int) -> DataFrame:
    """Adds slot: each shard's rows from 0 without a gap."""
    parts = 4 * int(n**0.5) // shards + 1
    placed = placed.withColumn("_part", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(parts)))
    return running(placed, ["shard"], ["_part"], ["row"], F.lit(1).cast("long"), "slot").drop("_part")


def equal_text_links(rows: DataFrame, n: int) -> DataFrame:
    """(a, b): trees that join the rows with an equal text. rows: row, text_hash; n: how many rows there are.

    A group's rows are dealt to about root-of-n parts by a hash; each row is linked with the first row of its part, and
    those with the group's first. So no row has more than about root-of-n links, and no join meets a whole group.
    """
    keyed = rows.select("row", "text_hash", F.pmod(F.xxhash64("row", F.lit(9)), F.lit(int(n**0.5) + 1)).alias("p"))
    heads = stored(keyed.groupBy("text_hash", "p").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("n")))
    tops = heads.groupBy("text_hash").agg(F.min("head").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("text_hash", "b")
    upper = heads.join(tops, "text_hash").filter("head <> b").select(F.col("head").alias("a"), "b")
    lower = keyed.join(heads.filter("n > 1"), ["text_hash", "p"]).filter("row <> head").select(F.col("row").alias("a"), F.col("head").alias("b"))
    return stored(upper.unionByName(lower))


def op10_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = stored(table(spark, sf_dir, "documents").select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.crc32(text)).alias("text_hash"),
    ))
    shards, n = 24, rows.count()
    placed = place(rows.select("row", "size"), equal_text_links(rows, n), shards)
    out = rows.join(slots(placed, n, shards), "row")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
