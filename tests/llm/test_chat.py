import hashlib

from riskgraph.llm.chat import choose_paths, format_paths, op2_reply_trees, parse

from .cases import write

MESSAGES = "tree_id long, id string, parent_id string, role string, text string, score double"
ROWS = "conv_id long, turn long, role string, text string, id string"


def want(rows):
    """By brute force: conv_id -> digests, rows in order of turn, role, text (nulls first)."""
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: [(x is not None, x if x is not None else 0) for x in r[1:4]])
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query(spark, tmp_path):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t} é🎉\\n<\\|") for t in range(37)]
    rows += [(2, 0, None, None), (2, 0, None, None), (2, None, "user", ""), (3, 5, "assistant", "\\"), (3, 4, "a\nb\\n", said), (None, 1, "assistant", "x"), (None, 0, "user", "y" * 100_000)]
    path = write(spark, tmp_path, spark.createDataFrame([(*r, "clash") for r in rows], ROWS), "conversations")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op2_reply_trees(spark, path).collect()}
    assert got == want([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    path = write(spark, tmp_path, spark.createDataFrame([], ROWS), "conversations")
    assert [r.conv_id for r in op2_reply_trees(spark, path).collect()] == [-1]


def test_branches(spark):
    m = [(1, "a", None, "user", "q", 1.0), (1, "b", "a", "assistant", "b", 0.2), (1, "c", "a", "assistant", "c", 0.9), (1, "d", "c", "user", "d", None),
         (1, "e", "c", "user", "e", 0.5), (2, "x", "gone", "user", "x", None), (2, "y", "x", "assistant", "y", None), (2, "z", "x", "assistant", "z", 0.0),
         (3, "k", "l", "user", "cycle", 1.0), (3, "l", "k", "user", "cycle", 1.0), (None, "s", "s", "assistant", "alone", 2.0)]
    df = spark.createDataFrame(m, MESSAGES)
    for n, expect in ((1, {"e", "y", "s"}), (2, {"e", "d", "y", "z", "s"})):
        paths = choose_paths(df, n)
        out = {r.path: (r.formatted, r.loss) for r in format_paths(df, paths).collect()}
        assert set(out) == expect
        assert [t for _, t in parse(out["e"][0])] == ["q", "c", "e"]
        assert [out["e"][0][s["start"] : s["stop"]] for s in out["e"][1]] == ["c"]
