"""Chat formatting of reply trees.

Messages name their parents. Iterative self-joins double the reach of each message's ancestor pointer, so a tree of
depth d takes about log2(d) joins, not d: they give each message's root, depth and the sum of scores on its path.
Leaves are ranked within a tree by the mean score from the root (ties: the smaller message id), a second run of
doublings lists the messages of each chosen root-to-leaf path, and each path becomes one conversation.

Template, a turn: <|im_start|>ROLE\\nTEXT<|im_end|>\\n. In texts and roles a backslash is doubled and "<|" becomes
"<\\|", so no text can hold a control string; in roles a line feed becomes "\\n" in letters. `loss` lists the
code-point ranges of assistant texts in the formatted conversation.

Cases: null text or role: empty; null score: 0; a message whose parent is missing (or null, or itself) is a root;
null and duplicate message ids or cycles of parents can't form a path from a root, so they raise no error: ids must
be unique within all trees, messages on a cycle have no root and are left out; a null tree id is a tree; an empty
table gives an empty result; other columns are ignored. A path's messages are gathered into one row, as its
conversation is one text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, stored, table

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def reach(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(id, root, depth, total) of each message under a root, and the pointer tables (id, up) to 2**k ancestors."""
    parent = F.when(F.col("parent_id") != F.col("id"), F.col("parent_id"))
    known = messages.select(F.col("id").alias("up"))
    base = messages.select("id", parent.alias("up"), F.coalesce("score", F.lit(0.0)).alias("total"))
    # a parent that isn't there makes a root
    cur = stored(
        base.filter("up IS NOT NULL").join(known, "up", "left_semi").select("id", "up", "total", F.lit(1).cast("long").alias("dist"))
    )
    roots = base.select("id", "total").join(cur.select("id"), "id", "left_anti")
    done = roots.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), "total")
    steps, most = [], messages.count().bit_length()  # more doublings than that are a cycle's
    while True:
        # pointers whose target is done end; the others jump as far again as they reach now
        steps.append(cur.select("id", "up"))
        end = done.select(F.col("id").alias("up"), "root", F.col("depth").alias("d"), F.col("total").alias("t"))
        new = cur.join(end, "up").select("id", "root", (F.col("dist") + F.col("d")).alias("depth"), (F.col("total") + F.col("t")).alias("total"))
        done = stored(done.unionByName(new))
        further = cur.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("dist").alias("more"), F.col("total").alias("t"))
        left = cur.join(further, "up").select("id", F.col("far").alias("up"), (F.col("total") + F.col("t")).alias("total"), (F.col("dist") + F.col("more")).alias("dist"))
        cur = stored(left)
        if cur.join(done.select("id"), "id", "left_anti").limit(1).count() == 0 or len(steps) >= most:
            return done.groupBy("id").agg(F.min("root").alias("root"), F.min("depth").alias("depth"), F.min("total").alias("total")), [*steps, cur.select("id", "up")]


def choose_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(path, rank, id, position): the messages of each tree's best root-to-leaf paths.

    messages: tree_id, id, parent_id, role, text, score.
    """
    done, steps = reach(messages)
    inner = messages.filter("parent_id IS NOT NULL AND parent_id <> id").select(F.col("parent_id").alias("id"))
    leaves = done.join(inner, "id", "left_anti").join(messages.select("id", "tree_id"), "id")
    leaves = leaves.select("tree_id", "id", (F.col("total") / (F.col("depth") + 1)).alias("value"))
    # the best of each salted part first, then of the parts: no tree's leaves meet in one task
    best = leaves.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    order = [F.desc("value"), "id"]
    for keys in (["tree_id", "salt"], ["tree_id"]):
        if branches == 1:
            one = F.min(F.struct((-F.col("value")).alias("v"), F.col("id"))).alias("s")
            best = best.groupBy(*keys).agg(one).select(*keys, F.col("s.id").alias("id"), (-F.col("s.v")).alias("value"), F.lit(1).alias("rank"))
        else:
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= branches)
    chosen = best.select(F.col("id").alias("path"), "rank")
    members = stored(chosen.select("path", F.col("path").alias("id")))
    for step in steps:
        members = stored(members.unionByName(members.join(step, "id").select("path", F.col("up").alias("id"))).distinct())
    return members.join(chosen, "path").join(done.select("id", F.col("depth").alias("position")), "id").select("path", "rank", "id", "position")


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree_id, path, rank, formatted, loss): each chosen path as one conversation."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    m = messages.select("id", "tree_id", head.alias("head"), escape(F.col("text")).alias("body"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"))
    turns = paths.join(m, "id").groupBy("path").agg(
        F.first("tree_id").alias("tree_id"), F.first("rank").alias("rank"),
        F.array_sort(F.collect_list(F.struct("position", "head", "body", "loss"))).alias("t"),
    )
    ends = f"""aggregate(t, struct(0L AS at, cast(array() AS array<struct<start: bigint, stop: bigint>>) AS spans), (a, x) -> struct(
        a.at + length(x.head) + length(x.body) + {len(END) + 1} AS at,
        if(x.loss, concat(a.spans, array(struct(a.at + length(x.head) AS start, a.at + length(x.head) + length(x.body) AS stop))), a.spans) AS spans), a -> a.spans)"""
    text = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    return turns.select("tree_id", "path", "rank", text.alias("formatted"), F.expr(ends).alias("loss"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from a formatted conversation alone."""
    out = []
    for part in formatted.split(START)[1:]:
        role, _, body = part.partition("\n")
        out.append((unescape(role), unescape_text(body[: body.rindex(END)])))
    return out


def unescape_text(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted text and the loss ranges alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape_text(text[s["start"] : s["stop"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([b.column("tree_id"), *map(pa.array, cols)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return conversations.select("tree_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def threads(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees: each row answers the one before it.

    Rows go by turn (nulls first), then role and text; a message's id is its conversation and number.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("n", F.row_number().over(w))
    name = lambda k: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.format_string("%010d", k))
    return n.select(
        F.col("conv_id").alias("tree_id"), name(F.col("n")).alias("id"), F.when(F.col("n") > 1, name(F.col("n") - 1)).alias("parent_id"),
        "role", "text", F.lit(0.0).alias("score"),
    )


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{END}{START}assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    messages = stored(threads(rows.unionByName(more)))
    return read_back(format_paths(messages, choose_paths(messages)))
