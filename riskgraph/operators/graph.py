"""Daily sliding-window entity graphs: pruning, components, attachment."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from .entities import TYPES, long_form

LOOKUP_ORDER = ["uid", "device", "addr", "card", "email"]  # the order in which a row looks up its component
_NEED = ["txn_id", "dt", "day", "amt", "label", "hour"]


def _written(df: DataFrame) -> DataFrame:
    """A table in the cluster's shared folder, read back: lineage ends, lost executors lose nothing, and joins know its
    size. Only a local session may go without a shared folder. The table goes when the application ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="riskgraph-graph-")
        sc.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/graph-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def window_members(df: DataFrame, cfg: Config, types: list[str] = TYPES) -> DataFrame:
    """(d, row): every row in each observed day's window [d - lookback, d). A row names its days: no range join."""
    days = df.select(F.col("day").alias("d")).distinct()
    each = F.explode(F.sequence(F.col("day") + 1, F.col("day") + cfg.lookback_days)).alias("d")
    return df.select(each, *_NEED, *types).join(days, "d", "left_semi")


def window_degrees(members: DataFrame, types: list[str] = TYPES) -> DataFrame:
    return long_form(members.select("d", "txn_id", *types), types, ["d", "txn_id"]).groupBy("d", "etype", "value").agg(F.count(F.lit(1)).alias("degree"))


def _forest(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Stars (d, u, v) around the smallest ids that join what every `most` edges join; never more edges than come in."""
    roots: dict[int, dict[int, int]] = {}
    held = 0

    def top(up: dict[int, int], x: int) -> int:
        path = []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def stars() -> pa.RecordBatch:
        edges = [(d, x, top(up, x)) for d, up in roots.items() for x in list(up)]
        roots.clear()
        columns = zip(*edges, strict=True) if edges else ([], [], [])
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["d", "u", "v"])

    for b in batches:
        for d, u, v in zip(*(b.column(c).to_pylist() for c in ("d", "u", "v")), strict=True):
            up = roots.setdefault(d, {})
            u, v = top(up, u), top(up, v)
            if u != v:
                up[max(u, v)] = min(u, v)
        held += b.num_rows
        if held >= most:
            held = 0
            yield stars()
    yield stars()


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(d, u, v): for every id that isn't its component's smallest, that smallest one. edges: long d, u, v.

    Tasks shrink blocks of a day's ids to forests first, within a bound of edges held. What crosses blocks is joined by
    alternating large-star and small-star steps (Kiveris et al. 2014), each a window over one exchange, until every id
    has one edge and no centre is an end; where a day's ids fit one block, no step is needed.
    """

    def shrunk(e: DataFrame) -> DataFrame:
        e = e.filter("u <> v").select("d", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        return _written(e.repartition("d", F.shiftright("u", 20)).mapInArrow(_forest, "d long, u long, v long").distinct())

    cur = shrunk(edges.select(*[F.col(c).cast("bigint").alias(c) for c in ("d", "u", "v")]))
    near = Window.partitionBy("d", "u")
    while True:
        ends = cur.select("d", "u", F.lit(1).alias("up"), F.lit(0).alias("centre")).unionByName(cur.select("d", F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("centre")))
        if not ends.groupBy("d", "u").agg(F.sum("up").alias("up"), F.max("centre").alias("centre")).filter("up > 0 AND up + centre > 1").take(1):
            return cur
        both = cur.unionByName(cur.select("d", F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(near))).filter("v > u").select("d", F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.filter("u <> v").withColumn("m", F.min("v").over(near))
        cur = shrunk(small.select("d", F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")))


def components(members: DataFrame, cfg: Config, types: list[str] = TYPES) -> tuple[DataFrame, DataFrame]:
    """(d, txn_id, comp) of all members and (d, etype, value, comp) of surviving values; comp is the smallest txn_id.

    A value links its rows to the smallest of them, so the graph has numbers only; values beyond the degree bounds are
    left out first.
    """
    deg = window_degrees(members, types).filter(F.col("degree").between(cfg.min_degree, cfg.max_degree))
    kept = _written(long_form(members.select("d", "txn_id", *types), types, ["d", "txn_id"]).join(deg, ["d", "etype", "value"]).select("d", "txn_id", "etype", "value"))
    low = kept.groupBy("d", "etype", "value").agg(F.min("txn_id").alias("low"))
    lab = smallest_reachable(kept.join(low, ["d", "etype", "value"]).select("d", F.col("txn_id").alias("u"), F.col("low").alias("v")))
    values = low.join(lab.select("d", F.col("u").alias("low"), "v"), ["d", "low"], "left").select("d", "etype", "value", F.coalesce("v", "low").alias("comp"))
    whole = members.select("d", "txn_id").join(lab.select("d", F.col("u").alias("txn_id"), "v"), ["d", "txn_id"], "left")
    return whole.select("d", "txn_id", F.coalesce("v", "txn_id").alias("comp")), values


def capped_components(members: DataFrame, cfg: Config, types: list[str] = TYPES) -> DataFrame:
    """(d, txn_id, comp, skipped): components grown greedily, rarest shared value first; a value that would push its
    component beyond the cap is skipped. The order is inherently sequential, so a day is one group: its size is bounded
    by the window, days run in parallel, and only ids and keys are sent."""
    # values of one row join nothing, common ones are pruned: only what can join is sent to a day's task
    rank = F.element_at(F.create_map(*[x for k, t in enumerate(types) for x in (F.lit(t), F.lit(k))]), F.col("etype"))
    long = long_form(members.select("d", "txn_id", "dt", *types), types, ["d", "txn_id", "dt"])
    deg = window_degrees(members, types).filter(F.col("degree").between(cfg.min_degree, cfg.max_degree))
    size = members.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    edges = long.join(deg, ["d", "etype", "value"]).join(size, "d").select("d", "txn_id", "dt", rank.alias("rank"), "value", "degree", "n")

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        cap = max(1, min(int(cfg.component_fraction * int(part["n"].iloc[0])), cfg.component_cap))
        part = part.sort_values(["dt", "txn_id"], kind="stable")
        root: dict[int, int] = {int(t): int(t) for t in part["txn_id"]}
        count = dict.fromkeys(root, 1)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        groups: dict[tuple, list[int]] = {}
        for t, r, v in zip(part["txn_id"], part["rank"], part["value"], strict=True):
            groups.setdefault((int(r), v), []).append(int(t))
        skipped = 0
        # the smallest degree first; ties: by type, then by the value's first row
        for _, rows in sorted(groups.items(), key=lambda g: (len(g[1]), g[0][0])):
            tops = sorted({find(t) for t in rows})
            total = sum(count[t] for t in tops)
            if total > cap:
                skipped += 1
                continue
            for t in tops[1:]:
                root[t] = tops[0]
            count[tops[0]] = total
        ids = list(root)
        return pd.DataFrame({"d": int(part["d"].iloc[0]), "txn_id": ids, "comp": [find(t) for t in ids], "skipped": skipped})

    found = edges.groupBy("d").applyInPandas(kernel, "d long, txn_id long, comp long, skipped long")
    return members.select("d", "txn_id").join(found, ["d", "txn_id"], "left").select("d", "txn_id", F.coalesce("comp", "txn_id").alias("comp"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


def attach(df: DataFrame, values: DataFrame, types: list[str] = TYPES) -> DataFrame:
    """(d, txn_id, comp) of today's rows that find a component: the first hit in lookup order. Nothing is merged."""
    order = F.element_at(F.create_map(*[x for k, t in enumerate(LOOKUP_ORDER) for x in (F.lit(t), F.lit(k))]), F.col("etype"))
    own = long_form(df.select("txn_id", F.col("day").alias("d"), *types), types, ["txn_id", "d"])
    return own.join(values, ["d", "etype", "value"]).groupBy("d", "txn_id").agg(F.min_by("comp", order).alias("comp"))


def attached_degrees(df: DataFrame, deg: DataFrame, types: list[str]) -> DataFrame:
    """Each row's degree per type in its day's window, 0 where there is none; pruned values count too."""
    own = long_form(df.select("txn_id", F.col("day").alias("d"), *types), types, ["txn_id", "d"])
    got = own.join(deg, ["d", "etype", "value"]).groupBy("txn_id").agg(*[F.max(F.when(F.col("etype") == t, F.col("degree"))).alias(t) for t in types])
    return df.select("txn_id").join(got, "txn_id", "left").select("txn_id", *[F.coalesce(F.col(t), F.lit(0)).alias(f"{t}_degree") for t in types])


def ring_rows(df: DataFrame, cfg: Config, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """(d, comp, role, row): window members and today's attached rows; and the surviving values' components."""
    members = window_members(df, cfg)
    comp, values = components(members, cfg, types)
    today = attach(df, values, types)
    old = members.join(comp, ["d", "txn_id"]).withColumn("role", F.lit("window"))
    new = df.select(*_NEED, *TYPES, F.col("day").alias("d")).join(today, ["d", "txn_id"]).withColumn("role", F.lit("today"))
    return old.unionByName(new), values


def graph_stats(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Per day: window rows, components, largest and median size (attached rows included), share attached."""
    per = rows.groupBy("d", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("role") == "window").cast("bigint")).alias("w"), F.sum((F.col("role") == "today").cast("bigint")).alias("t"))
    per = per.groupBy("d").agg(F.sum("w").alias("window_rows"), F.count(F.lit(1)).alias("n_components"), F.max("n").alias("largest"), F.expr("percentile(n, 0.5)").alias("median_size"), F.sum("t").alias("attached"))
    days = df.groupBy(F.col("day").alias("d")).agg(F.count(F.lit(1)).alias("rows_today"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return days.join(per, "d", "left").select(
        "d", z("window_rows").alias("window_rows"), z("n_components").alias("n_components"), z("largest").alias("largest"), F.round(z("median_size").cast("double"), 6).alias("median_size"),
        "rows_today", F.round(z("attached") * 100.0 / F.col("rows_today"), 4).alias("attached_pct"),
    )


def case_subgraph(rows: DataFrame, types: list[str], max_nodes: int = 60) -> DataFrame:
    """Edges transaction - entity of each case's first max_nodes transactions by time."""
    w = Window.partitionBy("comp").orderBy("dt", "txn_id")
    first = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max_nodes)
    return long_form(first.select("comp", "txn_id", *types), types, ["comp", "txn_id"])


def case_subgraph_nodes(rows: DataFrame, types: list[str], max_nodes: int = 60) -> DataFrame:
    """(comp, kind, node, amt, dt): each case's first max_nodes transactions by time, and the entities that they touch."""
    w = Window.partitionBy("comp").orderBy("dt", "txn_id")
    first = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= max_nodes)
    tx = first.select("comp", F.lit("transaction").alias("kind"), F.col("txn_id").cast("string").alias("node"), "amt", "dt")
    ent = long_form(first.select("comp", *types), types, ["comp"]).select("comp", F.col("etype").alias("kind"), F.col("value").alias("node")).distinct()
    return tx.unionByName(ent, allowMissingColumns=True)


def largest_share(comp: DataFrame) -> DataFrame:
    """(d, largest_share): the share of a window's rows in its largest component; near 1 where a hub wasn't pruned."""
    per = comp.groupBy("d", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("d").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return per.select("d", F.round(F.col("most") / F.col("all"), 6).alias("largest_share"))
