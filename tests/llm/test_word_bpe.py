import hashlib
import random

import pytest
from tokenizers import Tokenizer

from riskgraph.llm.packing import default_tokenizer
from riskgraph.llm.word_bpe import WordBpe, op7_word_bpe

from .cases import awkward, empty, write

PATH = default_tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t, WordBpe(PATH)


def test_equals_the_library(both):
    t, own = both
    rng = random.Random(5)
    texts = [" ".join(f"a{chr(c)}b{chr(c)}" for c in range(k, k + 64) if c and not 0xD800 <= c < 0xE000) for k in range(0, 0x34000, 64)]
    texts += ["".join(rng.choice("abcdeth ing'sé<|>ΣΑς1 \n") for _ in range(400)) for _ in range(300)]
    texts += ["x<|endoftext|>Y <|startoftext|>", "<|ENDOFTEXT|>", "ΟΔΟΣ ΑΣ", "ab" * 3000, "l'été é"]
    want = t.encode_batch(texts, add_special_tokens=False)
    bad = [k for k, (x, w) in enumerate(zip(texts, want, strict=True)) if own.encode(x) != w.ids]
    assert not bad, [hex(64 * k) for k in bad]
    for w in want[::17]:
        assert own.decode(w.ids) == t.decode(w.ids, skip_special_tokens=False)


def test_long_words_take_the_same_merges(both):
    own = both[1]
    rng = random.Random(9)
    for _ in range(300):
        w = "".join(rng.choice("abthein") for _ in range(rng.randint(2, 90))).encode()
        parts = [own.inner[b] for b in w[:-1]] + [own.last[w[-1]]]
        assert own._long(parts) == own.merge(w)


def test_query(spark, tmp_path, both):
    t = both[0]
    rows = awkward(spark)
    got = sorted(map(tuple, op7_word_bpe(spark, write(spark, tmp_path, rows)).collect()), key=str)
    want = []
    for r in rows.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert op7_word_bpe(spark, write(spark, tmp_path, empty(spark))).count() == 0
