import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskgraph.llm.packing import Packer, byte_encoder, default_tokenizer, op4_vector_packing

from .cases import awkward, empty, write

PATH = default_tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library_over_all_code_points(library):
    encode = byte_encoder(PATH)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}1 " for c in points[k : k + 64]) for k in range(0, 0x30000, 64)]
    texts += ["x<|endoftext|> y <|endoftext|>", "  \n\n a  b\t", "it's I'LL  we've"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    bad = [k for k, (t, w) in enumerate(zip(texts, want, strict=True)) if encode(t).tolist() != w]
    assert not bad, [hex(64 * k) for k in bad]


def check(pieces, texts, library):
    """Every id in exactly one piece, sequences gapless from 0 and within limits."""
    per, seq = {}, {}
    for p in pieces:
        per.setdefault(p["doc_id"], []).append(p)
        seq.setdefault(p["sequence_id"], []).append(p)
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(per.pop(doc), key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    assert not per
    for own in seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and len(own) <= 256
    return len(seq)


def test_awkward_rows(spark, tmp_path, library):
    docs = awkward(spark).dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    check([r.asDict() for r in op4_vector_packing(spark, write(spark, tmp_path, docs)).collect()], texts, library)
    assert op4_vector_packing(spark, write(spark, tmp_path, empty(spark))).count() == 0


def test_whole_table_with_little_padding(spark, library):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = [r.asDict() for r in op4_vector_packing(spark, d).collect()]
    n = check(got, docs, library)
    total = sum(p["length"] for p in got)
    assert n <= total / 2048 * 1.02 + 2 * len({p["sequence_id"] >> 40 for p in got})


def test_three_limits_hold_at_once():
    rng, packer = np.random.default_rng(1), Packer((100, 5, 40), 8, 32)
    items = [(k, t := int(rng.integers(1, 150)), int(rng.integers(0, min(t, 40) + 1))) for k in range(500)]
    out = [x for i in items for x in packer.add(*i)] + list(packer.finish())
    seen, use = {}, {}
    for s, _, _, k, start, length in out:
        assert start == seen.get(k, 0)
        seen[k] = start + length
        first = items[k][1] - items[k][2]
        u = use.setdefault(s, [0, 0, 0])
        u[0] += length
        u[1] += 1
        u[2] += max(0, start + length - max(start, first))
    assert seen == {k: t for k, t, _ in items}
    assert all(a <= 100 and b <= 5 and c <= 40 for a, b, c in use.values())
