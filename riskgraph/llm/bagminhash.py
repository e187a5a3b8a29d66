"""Near-duplicates by BagMinHash signatures over bags of five-word shingles.

A document's bag holds its shingles of `words` words (64-bit hashes) with their counts; a text of fewer words has one
shingle of them all; a text without words has none. The weighted Jaccard similarity of two bags is the sum of the
smaller counts over the sum of the larger.

Signature (after Ertl 2018): each shingle owns, for each interval of weights (0, 1], (1, 2], (2, 4], (4, 8], ..., a
Poisson process of points (time, slot, weight) with rate (interval's length) x (slots); counts are the discretised
weights. A document sees the points whose weight is not above its count, and keeps the smallest time of each slot.
Two documents share a slot's point with probability equal to their weighted Jaccard similarity, without bias.
Intervals wholly above the count are never entered, points of the one cut by it are thinned; a process stops once its
time is past the document's largest kept time, so a document costs little more than its number of shingles.

Equal texts are one class first. Signatures are cut into bands; texts that share a band and whose bags' sizes
allow it are candidates. Two sketches rule pairs out before any bag is read, so a passage that many texts share costs no
rows: two bits of every slot, and an odd sketch of the bag (Mitzenmacher et al. 2014: each occurrence of a shingle flips
one of 1024 bits), whose differing bits are never more than the occurrences by which two bags differ. A bucket never
gives all its pairs: first each member is verified against the bucket's smallest member, and links are joined to
components. Where a bucket still spans several components, the members outside its largest one are compared by sketch
with all that are not in their component; each text's closest candidate is verified, and then the candidates that still
join two components. Pairs left out lie in one component already, so the components are those of all candidate links.
Verification is exact, on whole bags.

Cases: null and empty texts are equal to each other; a null doc_id gives null ids only if its class has no other; repeated
rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forest, free_name, large_binary_column, mix, slices, stored, table, word_hashes

BANDS, BAND = 42, 6
SKETCH = 8  # longs of 63 bits: two bits of each of the 252 slots
ODD = 16  # longs of 64 bits: parities of shingle occurrences
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_STEPS = np.arange(1 << 16, dtype=np.uint64) * _GOLD


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bags of several texts: (text number, shingle, count), sorted by text and shingle."""
    h, at = word_hashes(data, offsets, fold=False)
    n = np.diff(at)
    made = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), made)
    first = np.repeat(at[:-1], made) + np.arange(len(doc)) - np.repeat(np.cumsum(made) - made, made)
    size = np.minimum(n, words)[doc]
    x = np.zeros(len(doc), _U)
    for k in range(words):
        inside = size > k
        w = h[np.minimum(first + k, max(len(h) - 1, 0))] if len(h) else x
        x = np.where(inside, (x ^ w) * _GOLD + _U(k + 1), x)
        x ^= x >> _U(29)
    x = mix(x)
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return doc[new], x[new], np.diff(np.append(new, len(doc)))


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, slots: int = BANDS * BAND) -> np.ndarray:
    """(texts, slots) times of the smallest points; a text without shingles has infinite times."""
    sig = np.full(texts * slots, np.inf)
    # processes: the interval (0, 1] of every shingle, and (2**(k-1), 2**k] for those with count > 2**(k-1)
    d, seed, low, high, top = [doc], [mix(shingle)], [np.zeros(len(doc))], [np.ones(len(doc))], [count.astype(float)]
    k = 0
    while True:
        more = count > (1 << k)
        if not more.any():
            break
        m = int(more.sum())
        d.append(doc[more])
        seed.append(mix(shingle[more] + _STEPS[k + 1]))
        low.append(np.full(m, float(1 << k)))
        high.append(np.full(m, float(2 << k)))
        top.append(count[more].astype(float))
        k += 1
    d, seed, low, high, top = (np.concatenate(x) for x in (d, seed, low, high, top))
    t, step = np.zeros(len(d)), 0
    while len(d):
        step += 1
        r = mix(seed + _STEPS[step % len(_STEPS)])
        u = ((r >> _U(11)).astype(float) + 0.5) * 2.0**-53
        t = t - np.log(u) / ((high - low) * slots)
        r = mix(r)
        slot = ((r >> _U(32)) * _U(slots) >> _U(32)).astype(np.int64)
        cut = np.flatnonzero(high > top)
        seen = np.ones(len(d), bool)
        if len(cut):  # the interval that the count cuts: its points above the count are not seen
            w = low[cut] + (high[cut] - low[cut]) * ((mix(r[cut]) >> _U(11)).astype(float) * 2.0**-53)
            seen[cut] = w < top[cut]
        np.minimum.at(sig, d[seen] * slots + slot[seen], t[seen])
        if step < 8 or step % 4 == 0:
            worst = sig.reshape(texts, slots).max(1)
        live = t < worst[d]
        if not live.all():
            d, seed, low, high, top, t = (x[live] for x in (d, seed, low, high, top, t))
    return sig.reshape(texts, slots)


def bands(sig: np.ndarray, per: int = BAND) -> np.ndarray:
    """(texts, bands) hashes of consecutive slots."""
    x = sig.view(_U).reshape(len(sig), -1, per)
    out = np.zeros(x.shape[:2], _U)
    for k in range(per):
        out = mix(out * _GOLD + x[:, :, k] + _U(k + 1))
    return out + np.arange(out.shape[1], dtype=_U) * _GOLD


def sketches(sig: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """(texts, longs) of 63 bits each: two bits of every slot."""
    two = mix(sig.view(_U))
    bits = np.concatenate([two & _U(1), (two >> _U(1)) & _U(1)], 1)[:, : 63 * longs].reshape(len(sig), longs, 63)
    return (bits << np.arange(63, dtype=_U)).sum(2, dtype=_U).view(np.int64)


def odd_sketches(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, longs: int = ODD) -> np.ndarray:
    """(texts, longs): each occurrence of a shingle flips one bit. Equal occurrences cancel, so two texts' sketches differ
    in at most as many bits as their bags differ in occurrences."""
    d, x = np.repeat(doc, count), np.repeat(shingle, count)
    nth = np.arange(len(d)) - np.repeat(np.cumsum(count) - count, count)
    place = (mix(x + nth.astype(_U) * _GOLD) % _U(64 * longs)).astype(np.int64)
    flips = np.bincount(d * (64 * longs) + place, minlength=texts * 64 * longs)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64).reshape(texts, longs)


def _lists(values: np.ndarray) -> pa.ListArray:
    """A list of each row of values."""
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.ravel())


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 128):
        data, off = large_binary_column(b, "text")
        doc, x, n = shingles(data, off)
        sig = signatures(doc, x, n, b.num_rows)
        size = np.bincount(doc, n, b.num_rows).astype(np.int64)
        odd = odd_sketches(doc, x, n, b.num_rows)
        yield pa.record_batch({"doc_id": b.column("doc_id"), "key": b.column("key"), "size": size, "bands": _lists(bands(sig).view(np.int64)), "sketch": _lists(sketches(sig)), "odd": _lists(odd)})


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 128):
        doc, x, n = shingles(*large_binary_column(b, "text"))
        ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
        cut = list(zip(ends[:-1], ends[1:], strict=True))
        bag = [x[i:j].tobytes() + n[i:j].astype("<u4").tobytes() for i, j in cut]
        yield pa.record_batch({"key": b.column("key"), "bag": pa.array(bag, pa.binary())})


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two bags (sorted shingles, then counts)."""
    na, nb = len(a) // 12, len(b) // 12
    xa, xb = np.frombuffer(a, _U, na), np.frombuffer(b, _U, nb)
    ca, cb = np.frombuffer(a, "<u4", na, na * 8), np.frombuffer(b, "<u4", nb, nb * 8)
    i = np.searchsorted(xb, xa)
    i[i == nb] = 0
    hit = xb[i] == xa if nb else np.zeros(na, bool)
    both = int(np.minimum(ca[hit], cb[i[hit]]).sum())
    total = int(ca.sum()) + int(cb.sum()) - both
    return both / total if total else 1.0


def _verify(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The rows of pairs (a, b, other columns) whose bags are at least so similar."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            ok = [similarity(x, y) >= least for x, y in zip(b.column("bag_a").to_pylist(), b.column("bag_b").to_pylist(), strict=True)]
            yield b.select(names).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(bags.select(F.col("key").alias("a"), F.col("bag").alias("bag_a")), "a")
    both = both.join(bags.select(F.col("key").alias("b"), F.col("bag").alias("bag_b")), "b")
    return stored(both.select(*names, "bag_a", "bag_b").mapInArrow(run, pairs.select(*names).schema), narrow=True)


def _differ(a: str, b: str, longs: int) -> Column:
    """In how many bits two sketches (columns a0, a1, ... and b0, b1, ...) differ."""
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(longs)), F.lit(0))


def _alike(a: str, b: str, least: float) -> Column:
    """Whether two texts (columns size_a, sketch_a0, odd_a0 and so on) can have similarity `least`.

    A slot that differs has each of its two bits differ by chance, so the share of differing bits has mean (1 - s) / 2;
    five standard deviations are allowed (3e-7 is lost). Bags of n occurrences together that are so similar differ in at
    most n (1 - least) / (1 + least) of them; as many bits may differ in the odd sketches, or, for long texts, what so
    many flips of random bits give plus six standard deviations (1e-9 is lost).
    """
    size_a, size_b = F.col(f"size_{a}"), F.col(f"size_{b}")
    slots = 63 * SKETCH / 2
    mean = (1 + least) / 2
    spread = ((least + (1 - least) * 0.375 - mean * mean) / slots) ** 0.5
    most = int(63 * SKETCH * (1 - mean + 5 * spread)) + 1
    flips = (size_a + size_b) * ((1 - least) / (1 + least))
    p = (1 - F.exp(flips * (-2.0 / (64 * ODD)))) / 2
    bound = F.least(flips, p * (64 * ODD) + 6 * F.sqrt(p * (1 - p) * (64 * ODD))) + 1e-6
    fits = F.least(size_a, size_b) >= least * F.greatest(size_a, size_b)
    return fits & (_differ(f"sketch_{a}", f"sketch_{b}", SKETCH) <= most) & (_differ(f"odd_{a}", f"odd_{b}", ODD) <= bound)


def _keyed(docs: DataFrame, name: str = "key") -> DataFrame:
    """Adds a key of 16 bytes that equal texts share."""
    return docs.withColumn(name, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))


def _classed(docs: DataFrame, least: float) -> DataFrame:
    """(doc_id, key, least, class_id) of each row: least is the smallest id with the text, class_id the class's."""
    docs = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = stored(docs.mapInArrow(_describe, "doc_id long, key binary, size long, bands array<long>, sketch array<long>, odd array<long>"))
    texts = stored(rows.groupBy("key").agg(F.min("doc_id").alias("least"), *(F.first(c).alias(c) for c in ("size", "bands", "sketch", "odd"))))
    named = texts.filter("size > 0").select("key", F.explode("bands").alias("band"))
    shared = named.groupBy("band").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = stored(named.join(shared.drop("n"), "band"))

    def side(name: str) -> DataFrame:
        longs = [F.col(c)[k].alias(f"{c}_{name}{k}") for c, n in (("sketch", SKETCH), ("odd", ODD)) for k in range(n)]
        return texts.select(F.col("key").alias(name), F.col("size").alias(f"size_{name}"), *longs)

    pairs = buckets.filter("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    pairs = stored(pairs.join(side("a"), "a").join(side("b"), "b").filter(_alike("a", "b", least)).select("a", "b"))
    # whole bags of the texts that share a band, one row each, and nothing of the others
    wanted = buckets.select("key").distinct().join(texts.select("key", "least"), "key")
    one = (docs["key"] == wanted["key"]) & docs["doc_id"].eqNullSafe(wanted["least"])
    bags = stored(docs.join(wanted, one, "left_semi").select("key", "text").mapInArrow(_bags, "key binary, bag binary").dropDuplicates(["key"]))
    links = _verify(pairs, bags, least)
    # what stars leave open: members outside their bucket's largest component, against all others of the bucket
    roots = stored(components(links), narrow=True)
    part = buckets.select("band", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sizes = part.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("band").agg(F.max(F.struct("n", "root")).alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("band", F.col("m.root").alias("main"))
    part = stored(part.join(most, "band"))
    all_of, out = (part.filter(which).select("band", F.col("key").alias(x), F.col("root").alias(f"root_{x}"), F.col("main").alias(f"main_{x}")).join(side(x), x) for x, which in (("b", "true"), ("a", "root <> main")))
    once = (F.col("root_b") == F.col("main_b")) | (F.col("a") < F.col("b"))  # else both ends are outside, and each would find the other
    open_ = all_of.join(out.drop("main_a"), "band").filter((F.col("root_a") != F.col("root_b")) & once & _alike("a", "b", least))
    swap = F.col("a") > F.col("b")
    ends = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("root_a", "root_b"), ("root_b", "root_a"))]
    open_ = open_.select(*ends, _differ("odd_a", "odd_b", ODD).alias("far"))
    open_ = stored(open_.distinct().join(pairs, ["a", "b"], "left_anti"))
    # the closest candidate of each text joins most components, and few candidates are left to verify
    ends = open_.select(F.explode(F.array("a", "b")).alias("key"), F.struct("far", "a", "b", "root_a", "root_b").alias("pair"))
    first = stored(ends.groupBy("key").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b", "pair.root_a", "pair.root_b").distinct(), narrow=True)
    joined = _verify(first, bags, least).select(F.greatest("root_a", "root_b").alias("u"), F.least("root_a", "root_b").alias("v"))
    # a part of what these join is enough to leave candidates out
    near = stored(joined.distinct().mapInArrow(forest, joined.schema).groupBy("u").agg(F.min("v").alias("v")), narrow=True)
    rest = open_.drop("far").join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(near.select(F.col("u").alias(f"root_{end}"), F.col("v").alias(f"near_{end}")), f"root_{end}", "left")
    rest = rest.filter(F.coalesce("near_a", "root_a") != F.coalesce("near_b", "root_b")).select("a", "b", "root_a", "root_b")
    more = _verify(stored(rest, narrow=True), bags, least)
    tops = components(joined.unionByName(more.select(F.col("root_a").alias("u"), F.col("root_b").alias("v"))), "u", "v")
    found = texts.select("key", "least").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    found = found.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("key", "least", F.coalesce("top", "root").alias("root"))
    ids = found.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key")).alias("m"))
    by_text = found.join(ids, "root").select("key", "least", F.col("m.least").alias("class_id"), F.col("m.key").alias("best"))
    return rows.select("doc_id", "key").join(by_text, "key")


def classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, class_id): class_id is the smallest doc_id of a near-duplicate class. docs: doc_id, text."""
    return _classed(docs, least).select("doc_id", "class_id")


def keep_one(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row of each class, whole: that with the smallest id."""
    own = _classed(docs, least).filter((F.col("key") == F.col("best")) & F.col("doc_id").eqNullSafe(F.col("least")))
    chosen = stored(own.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies")))
    name = free_name(docs, "key")
    keyed = _keyed(docs, name)

    def rows_of(some: DataFrame) -> DataFrame:
        same = (keyed[name] == some["key"]) & keyed["doc_id"].cast("long").eqNullSafe(some["doc_id"])
        return keyed.join(some, same, "left_semi")

    out = rows_of(chosen.filter("copies = 1"))
    if chosen.filter("copies > 1").limit(1).count():
        out = out.unionByName(rows_of(chosen.filter("copies > 1")).dropDuplicates(["doc_id", name]))
    return out.drop(name)


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))
