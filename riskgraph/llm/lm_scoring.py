"""Language-model scoring with a probabilistic suffix tree over words.

Training reads every training text:

1. Word counts c, their sum N and the number of words V (words are 64-bit hashes, and so are sequences of words; two
   of ten million share one with probability about 3e-6).
2. For lengths 2 .. max_depth + 1: counts of the sequences (a context and the word after it), summed before and in a
   shuffle. Those with at least `least` occurrences are held, whatever N is, so the tree grows with the input. A
   sequence reaches the shuffle only if a filter of fixed size may hold both of its parts of one word less; the
   filter never denies a held one, so it saves work and drops nothing. A context grows by a word in front only if the
   held words after it cost at least min_gain nats: no longer context can gain more than they cost.
3. Divergence test: a context stays if the log-likelihood that its next-word distribution gains over its
   suffix's (count times Kullback-Leibler divergence) is at least min_gain, or if a longer context needs it.

A state's distribution is P(x|s) = max(n(sx) - discount, 0) / n(s) for held pairs, plus the mass left over times
P(x | suffix of s); the empty state has the add-one distribution (c + 1) / (N + V + 1). So every state's
distribution sums to one, unknown words sharing 1 / (N + V + 1). A text's score adds log10 P(x|s) with s the
longest suffix of the words before x in the tree; the end of a text is a symbol, contexts don't cross texts.

Each kept context adds the log of its mass left over to each token after it, and each held pair of a kept context takes
that back and adds log10 of P(x|s) / P(x | suffix of s). So a text's score is its base plus a sum of one value for
each sequence in it. All values lie in a written table that scoring meets in a shuffle; words and sequences with a
share of at least 1 / head_bound, of which there are at most head_bound a length, are broadcast as a shortcut.

Cases: a null or empty text has the end token alone; a null doc_id counts as the empty string for the fold;
repeated rows each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collected, forget, large_binary_column, mix, slices, stored, table, trim, word_hashes

END = np.uint64(0x0E0D0E0D0E0D0E0D)
_R = np.uint64(0x9E3779B97F4A7C15)
_FILTER_WORDS = 21
_PART_NAMES = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "more"]


@dataclass
class Tree:
    """total and distinct words; values (h, c, f, value): each word's count c, each sequence's count f and value."""

    total: int
    distinct: int
    longest: int
    values: DataFrame

    @property
    def unknown(self) -> float:
        return -float(np.log10(self.total + self.distinct + 1))


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one END after each text, and each text's offset."""
    h, at = word_hashes(*large_binary_column(batch, "text"), fold=True)
    out = np.insert(h, at[1:], END)
    return out, at + np.arange(len(at))


def _key(s: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The key of a sequence from those of all but its last and all but its first word."""
    return mix(s * _R + u)


def sequences(tok: np.ndarray, at: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the keys of the sequences that end at each token, and the tokens where one text holds them."""
    left = np.arange(len(tok)) - np.repeat(at[:-1], np.diff(at))
    key = tok
    for n in range(1, longest + 1):
        if n > 1:
            key = np.concatenate([np.zeros(1, np.uint64), _key(key[:-1], key[1:])])
        yield key, np.flatnonzero(left >= n - 1)


class Index:
    """Finds hashes among sorted distinct ones by a table of where each range of hashes starts."""

    def __init__(self, keys: np.ndarray):
        bins = max(1, len(keys).bit_length())
        self.n, self.shift = len(keys), np.uint64(64 - bins)
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.start = np.searchsorted(keys, np.arange(1 << bins, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, want: np.ndarray) -> np.ndarray:
        """Index of each wanted hash, or -1."""
        out = np.full(len(want), -1, np.int64)
        open_, at = np.arange(len(want)), self.start[want >> self.shift]
        while len(open_):
            key = self.keys[at]
            hit = (key == want) & (at < self.n)
            out[open_[hit]] = at[hit]
            more = key < want  # a range holds about one key
            open_, at, want = open_[more], at[more] + 1, want[more]
        return out


def _mask(keys: np.ndarray) -> np.ndarray:
    one = np.uint64(1)
    return (one << (keys & np.uint64(63))) | (one << ((keys >> np.uint64(6)) & np.uint64(63)))


def _filter(keys: DataFrame, tokens: int) -> np.ndarray:
    """Two bits in one word for each key h, in a table of two bits a token, of 16 MB at most: set bits may be other keys'.

    Tasks send the words that they set, by blocks of the table; a block's words meet in one task, whatever their number.
    """
    words = max(10, min(_FILTER_WORDS, (tokens >> 5).bit_length()))
    block = words - 6

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << words, np.uint64)
        for b in it:
            h = b["h"].to_numpy().view(np.uint64)
            np.bitwise_or.at(bits, (h >> np.uint64(64 - words)).astype(np.intp), _mask(h))
        at = np.flatnonzero(bits)
        if len(at):
            got = list(zip(*_dealt((at >> block).astype(np.int32), at, bits[at], steps=0), strict=True))
            yield pa.record_batch({"block": pa.array(got[0], pa.int32()), "bits": pa.array(got[1], pa.binary())})
        del bits, at
        trim()

    def joined(part: pa.Table) -> pa.Table:
        at, some = _undealt(part["bits"], "<i8", "<u8", steps=0)
        bits = np.zeros(1 << block, np.uint64)
        np.bitwise_or.at(bits, at & ((1 << block) - 1), some)
        return pa.table({"block": part["block"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    kinds = "block int, bits binary"
    got = collected(keys.select("h").mapInArrow(own, kinds).groupBy("block").applyInArrow(joined, kinds))
    out = np.zeros((64, 1 << block), np.uint64)
    for k, raw in zip(got["block"].to_pylist(), got["bits"].to_pylist(), strict=True):
        out[k] = np.frombuffer(raw, "<u8")
    return out.ravel()


def _may(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word = bits[keys >> np.uint64(65 - len(bits).bit_length())]
    return (word >> (keys & np.uint64(63))) & (word >> ((keys >> np.uint64(6)) & np.uint64(63))) & np.uint64(1) > 0


def _sum(s: np.ndarray, u: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of keys with their counts."""
    key = _key(s, u)
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    n = np.diff(np.append(new, len(key))) if c is None or not len(key) else np.add.reduceat(c[order].astype(np.int64), new)
    return s[order[new]], u[order[new]], n


def _gather(batches: Iterator[pa.RecordBatch], parts_of: Callable, flush: int = 1_000_000) -> Iterator[tuple]:
    """Sums counts of pairs of keys within a task, never holding more than about flush of them."""
    held: list[tuple] = []
    n = 0

    def one() -> tuple:
        s, u, c = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return _sum(s, u, c)

    for b in slices(batches):
        s, u = parts_of(b)
        held.append((s, u, np.ones(len(s), np.uint32)))
        n += len(s)
        if n > flush:
            some = one()
            n = len(some[0])
            if n > flush // 2:
                yield some
                n = 0
            else:
                held.append(some)
            del some
    if n:
        yield one()


def _dealt(bucket: np.ndarray, *columns: np.ndarray, steps: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(bucket, rows) for each bucket that has rows: the bytes of one column after the other.

    steps: the number of a column, long and rising, that is held as differences. Signed whole numbers, which are small,
    have their lowest bytes first, then the next: the zeros lie side by side, so they pack well.
    """
    small = not len(bucket) or bucket.max() < 1 << 16
    order = np.argsort(bucket.astype(np.uint16) if small else bucket, kind="stable")  # short numbers sort in linear time
    bucket, columns = bucket[order], tuple(x[order] for x in columns)
    cut = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)) if len(bucket) else [0]
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        own = [np.diff(x[lo:hi], prepend=0) if k == steps else x[lo:hi] for k, x in enumerate(columns)]
        yield int(bucket[lo]), b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() if x.dtype.kind == "i" else x.tobytes() for x in own)


def _undealt(blobs: Iterable[pa.Scalar], *types: str, steps: int | None = None) -> list[np.ndarray]:
    """The columns of all rows of _dealt in one bucket."""
    width, parts = sum(np.dtype(t).itemsize for t in types), [[np.zeros(0, t)] for t in types]
    for x in blobs:
        if not x.is_valid:
            continue
        raw = x.as_buffer()
        n, at = raw.size // width, 0
        for k, (t, out) in enumerate(zip(types, parts, strict=True)):
            size = np.dtype(t).itemsize
            own = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.ravel().view(t) if np.dtype(t).kind == "i" else np.frombuffer(raw, t, n, at)
            out.append(np.cumsum(own) if k == steps else own)
            at += n * size
    return [np.concatenate(x) for x in parts]


def _blocks(blobs: pa.ChunkedArray, most: int = 4 << 20) -> Iterator[list[pa.Scalar]]:
    """The blobs that are not null, in lists of about `most` bytes."""
    some, size = [], 0
    for x in blobs:
        if x.is_valid:
            some.append(x)
            size += x.as_buffer().size
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def _short(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low 48 bits of hashes. In a bucket of the top bits two of some hundred thousand share them as rarely as whole
    hashes are shared in a large corpus."""
    return h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint16)


def _long(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What _short left of hashes, in the top bits."""
    return (high.astype(np.uint64) << np.uint64(48)) | (low.astype(np.uint64) << np.uint64(16))


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def _counted(texts: DataFrame, parts_of: Callable, bits: int, least: int) -> DataFrame:
    """(h, s, u, c): the pairs of keys that parts_of finds in batches of texts, with counts of at least `least`.

    A task sums its own and sends one row for each of the 2**bits buckets by the pair's hash, so a frequent word's
    pairs are spread over all buckets, and a bucket holds about as many pairs as any other.
    """

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, u, c in _gather(it, parts_of):
            got = list(zip(*_dealt(_bucket(_key(s, u), bits), s, u, c.astype(np.uint32)), strict=True))
            yield pa.record_batch({"bucket": pa.array(got[0], pa.int32()), "pairs": pa.array(got[1], pa.binary())})
            del s, u, c, got
        trim()

    def total(part: pa.Table) -> pa.Table:
        trim()
        s, u, c = _sum(*_undealt(part["pairs"], "<u8", "<u8", "<u4"))
        ok = c >= least
        s, u, c = s[ok], u[ok], c[ok]
        return pa.table({"h": _key(s, u).view(np.int64), "s": s.view(np.int64), "u": u.view(np.int64), "c": c})

    return texts.mapInArrow(deal, "bucket int, pairs binary").groupBy("bucket").applyInArrow(total, "h long, s long, u long, c long")


def _bits(rows: int, each: int) -> int:
    """The power of two of buckets that gives each about `each` rows."""
    return max(4, (rows // each).bit_length())


def train(texts: DataFrame, max_depth: int = 3, least: int = 2, min_gain: float = 12.0, discount: float = 0.75) -> Tree:
    """The tree. texts: column text; null counts as empty."""
    spark = texts.sparkSession
    texts = texts.select("text")
    wide = int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length()
    words = _counted(texts, lambda b: (t := tokens(b)[0], np.zeros_like(t)), max(4, wide), 1)
    counts = stored(words.select(F.col("s").alias("h"), "c"), narrow=True)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("h")).first()
    level = counts.filter(F.col("c") >= least).select("h", "c", ((F.col("c") + 1) / F.lit(float(total + distinct + 1))).alias("p"), F.lit(None).cast("long").alias("u"))
    levels: list[tuple[DataFrame, DataFrame]] = []
    for length in range(2, max_depth + 2):
        held = _filter(level, total)
        grown = _filter(levels[-1][1].filter(F.col("cost") >= min_gain).select(F.col("s").alias("h")), total) if levels else None
        sent = spark.sparkContext.broadcast((held, grown))

        def parts(b: pa.RecordBatch, sent=sent, length=length) -> tuple[np.ndarray, np.ndarray]:
            held, grown = sent.value
            *_, (key, _), (_, at) = below = list(sequences(*tokens(b), length))
            s, u = key[at - 1], key[at]
            ok = _may(held, s) & _may(held, u)
            if grown is not None:  # the context's suffix ends where the context does
                ok &= _may(grown, below[-3][0][at - 1])
            return s[ok], u[ok]

        found = stored(_counted(texts, parts, _bits(total, 1 << 20), least), narrow=True)
        sent.destroy()
        mass = found.groupBy("s").agg(F.sum(F.col("c") - discount).alias("mass"))
        state = level.select(F.col("h").alias("s"), F.col("c").alias("n"), F.col("u").alias("up")).join(mass.hint("shuffle_hash"), "s")
        state = stored(state.select("s", "up", "n", F.greatest(1 - F.col("mass") / F.col("n"), F.lit(1e-12)).alias("left")), narrow=True)
        half = found.join(state.select("s", "n", "left").hint("shuffle_hash"), "s").select("h", "s", "u", "c", "n", "left")
        # the suffix's pair is as frequent, so it is held
        p = (F.col("c") - discount) / F.col("n") + F.col("left") * F.col("below")
        pairs = stored(half.join(level.select(F.col("h").alias("u"), F.col("p").alias("below")).hint("shuffle_hash"), "u").select("h", "s", "u", "c", p.alias("p"), "below"), narrow=True)
        forget(found)
        told = pairs.groupBy("s").agg(F.sum(F.col("c") * F.log(F.col("p") / F.col("below"))).alias("won"), F.sum(-F.col("c") * F.log("p")).alias("cost"), F.sum("c").alias("inside"))
        gain = F.col("won") + F.greatest(F.col("n") - F.col("inside"), F.lit(0)) * F.log("left")
        levels.append((pairs, stored(state.join(told.hint("shuffle_hash"), "s").select("s", "up", "n", "left", gain.alias("gain"), "cost"), narrow=True)))
        forget(state)
        level = pairs
        if not level.take(1):
            break
    values = counts.select("h", "c", F.col("c").alias("f"), F.lit(0.0).alias("value"))
    for part in _keep(levels, min_gain):
        values = values.unionByName(part.select("h", F.lit(None).cast("long").alias("c"), "f", "value"))
    return Tree(total, distinct, max_depth + 1, values)


def _keep(levels: list[tuple[DataFrame, DataFrame]], min_gain: float) -> Iterator[DataFrame]:
    """Divergence tests, the longest contexts first. (h, f, value) of kept contexts, and of their pairs."""
    longer = None
    for pairs, told in reversed(levels):
        state, needed = told, F.col("gain") >= min_gain
        if longer is not None:
            state = state.join(longer.select(F.col("up").alias("s")).distinct().withColumn("below", F.lit(True)), "s", "left")
            needed |= F.col("below").isNotNull()
        longer = stored(state.filter(needed).select("s", "up", "n", "left"), narrow=True)
        yield longer.select(F.col("s").alias("h"), F.col("n").alias("f"), F.log10("left").alias("value"))
        value = F.log10(F.col("p") / F.col("below")) - F.log10("left")
        own = pairs.join(longer.select("s", "left").hint("shuffle_hash"), "s").select("h", F.col("c").alias("f"), value.alias("value"))
        yield stored(own, narrow=True)
        forget(pairs, told)


_PART = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, more double"


def score(docs: DataFrame, tree: Tree, head_bound: int = 1 << 20) -> DataFrame:
    """docs: doc_id, text, held_out. Words and sequences that aren't in the head meet their exact values in a shuffle
    by buckets of their hashes; base is the sum over words alone, more what the tree adds to it."""
    spark = docs.sparkSession
    floor = max(2, -(-tree.total // head_bound))
    head = collected(tree.values.filter(F.col("f") >= floor).select("h", F.coalesce("c", F.lit(0)).alias("c"), "value"))
    keys, back = np.unique(head["h"].to_numpy().view(np.uint64), return_inverse=True)  # at most one row of a key is a word's
    counts, values = (np.bincount(back, head[x].to_numpy(), len(keys)) for x in ("c", "value"))
    rest = _filter(tree.values.filter((F.col("f") < floor) & F.col("c").isNull()), tree.total)
    near = np.zeros(1 << 16, np.uint64)
    np.bitwise_or.at(near, keys >> np.uint64(48), _mask(keys))
    sent = spark.sparkContext.broadcast((Index(keys), np.log10(counts + 1.0), values, near, rest))
    longest, unknown, bits = tree.longest, tree.unknown, _bits(tree.total, 1 << 21)
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    met = pa.schema([("home", pa.int32()), ("sums", pa.binary()), *zip(_PART_NAMES, kinds, strict=True)])
    home_bits = _bits(tree.total, 1 << 22)

    def home(rows: np.ndarray) -> np.ndarray:
        """The bucket of texts that a text is in."""
        return _bucket(mix(rows.view(np.uint64)), home_bits)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, logs, values, near, rest = sent.value
        held: list[list[np.ndarray]] = [[], [], []]
        size_held = 0

        def flush() -> pa.RecordBatch:
            h, row, n = (np.concatenate(x) for x in held)
            for x in held:
                x.clear()
            got = list(zip(*_dealt(_bucket(h, bits), *_short(h), row, n, steps=2), strict=True)) or [[], []]
            none = {f: pa.nulls(len(got[0]), t) for f, t in zip(_PART_NAMES, kinds, strict=True)}
            return pa.record_batch({"bucket": pa.array(got[0], pa.int32()), "tail": pa.array(got[1], pa.binary()), **none})

        for b in slices(it):
            tok, at = tokens(b)
            size, rows = np.diff(at), b.num_rows
            doc, ids = np.repeat(np.arange(rows), size), b["row"].to_numpy()
            base, more, known, left = np.zeros(rows), np.zeros(rows), np.zeros(rows), []
            alive = np.ones(len(tok), bool)
            for n, (key, where) in enumerate(sequences(tok, at, longest)):
                where = where[alive[where]]  # a sequence has a value only if the one without its first word has one
                key, d = key[where], doc[where]
                i, maybe = np.full(len(key), -1, np.int64), np.flatnonzero(_may(near, key))
                i[maybe] = head.find(key[maybe])
                hit = i >= 0
                more += np.bincount(d[hit], values[i[hit]], rows)
                if not n:
                    base += np.bincount(d[hit], logs[i[hit]] + unknown, rows)
                    known += np.bincount(d[hit], minlength=rows)
                out = ~hit if not n else ~hit & _may(rest, key)
                left.append((key[out], d[out], np.full(out.sum(), not n)))
                if n:
                    alive[:] = False
                    alive[where[hit | out]] = True
            h, d, word = (np.concatenate(x) for x in zip(*left, strict=True))
            if len(h):
                _, first, n = np.unique(_key(h, d.astype(np.uint64)), return_index=True, return_counts=True)
                order = np.argsort(d[first], kind="stable")  # a text's entries lie side by side, so its number packs well
                first, n = first[order], n[order]
                held[0].append(h[first])
                held[1].append(ids[d[first]])
                held[2].append((2 * n + word[first]).astype(np.int32))  # words have odd numbers
                size_held += len(first)
            yield pa.record_batch({
                "bucket": _bucket(mix(ids.view(np.uint64)), bits), "tail": pa.nulls(rows, pa.binary()), "row": b["row"], "doc_id": b["doc_id"], "held_out": b["held_out"],
                "n_tokens": size.astype(np.int64), "n_known": known.astype(np.int64), "base": base, "more": more,
            })
            if size_held > 500_000:
                size_held = 0
                yield flush()
        if size_held:
            yield flush()
        trim()

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            h, c, value = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            got = list(zip(*_dealt(_bucket(h, bits), *_short(h), c, value), strict=True))
            return pa.record_batch({"bucket": pa.array(got[0], pa.int32()), "model": pa.array(got[1], pa.binary())})

        for b in it:
            if b.num_rows:
                held.append((b["h"].to_numpy().view(np.uint64), b["c"].fill_null(0).to_numpy().astype(np.uint32), b["value"].to_numpy()))
            if sum(len(x[0]) for x in held) > 500_000:
                yield flush()
        if held:
            yield flush()
        trim()

    def meet(part: pa.Table, model: pa.Table) -> pa.Table:
        """Texts' own rows as they came, and what the bucket adds to texts, packed for the bucket of texts it goes to."""
        if not part.num_rows:  # no text asks this bucket
            return met.empty_table()
        trim()
        own = part.filter(part["row"].is_valid()).select(_PART_NAMES)
        *keys, c, value = _undealt(model["model"] if model.num_rows else [], "<u4", "<u2", "<u4", "<f8")
        keys, back = np.unique(_long(*keys), return_inverse=True)
        c, value = np.bincount(back, c, len(keys)), np.bincount(back, value, len(keys))
        index, parts = Index(keys), [[np.zeros(0, t)] for t in ("<i8", "<i8", "<f8", "<f8")]
        for blobs in _blocks(part["tail"]):  # a text's entries are in one of them
            *h, row, n = _undealt(blobs, "<u4", "<u2", "<i8", "<i4", steps=2)
            i = index.find(_long(*h))
            hit, word, times = i >= 0, n & 1 > 0, n >> 1
            count = np.where(hit, c[i], 0) if len(keys) else np.zeros(len(n))
            more = np.where(hit, value[i], 0.0) * times if len(keys) else np.zeros(len(n))
            base = np.where(word, times * (np.log10(count + 1.0) + unknown), 0.0)
            rows, at = np.unique(row, return_inverse=True)
            known, base, more = (np.bincount(at, x, len(rows)) for x in (times * (word & (count > 0)), base, more))
            for out, x in zip(parts, (rows, known.astype(np.int64), base, more), strict=True):
                out.append(x)
        rows, *sums = (np.concatenate(x) for x in parts)
        order = np.argsort(rows, kind="stable")
        rows, sums = rows[order], [x[order] for x in sums]
        got = list(zip(*_dealt(home(rows), rows, *sums, steps=0), strict=True)) or [[], []]
        packed = [pa.array(got[0], pa.int32()), pa.array(got[1], pa.binary()), *(pa.nulls(len(got[0]), t) for t in kinds)]
        own = [pa.array(home(own["row"].to_numpy())), pa.nulls(own.num_rows, pa.binary()), *own.columns]
        return pa.concat_tables([pa.Table.from_arrays(own, schema=met), pa.Table.from_arrays(packed, schema=met)])

    def total(part: pa.Table) -> pa.Table:
        trim()
        own = part.filter(part["row"].is_valid())
        ids = own["row"].to_numpy()
        order = np.argsort(ids)
        row, *sums = _undealt(part["sums"], "<i8", "<i8", "<f8", "<f8", steps=0)
        at = order[np.searchsorted(ids[order], row)]
        known, base, more = (own[c].to_numpy() + np.bincount(at, x, len(ids)) for c, x in zip(("n_known", "base", "more"), sums, strict=True))
        return pa.table({"doc_id": own["doc_id"], "held_out": own["held_out"], "n_tokens": own["n_tokens"], "n_known": known.astype(np.int64), "base_score": base, "score": base + more})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text", "held_out")
    sides = rows.mapInArrow(run, f"bucket int, tail binary, {_PART}"), tree.values.filter(F.col("f") < floor).mapInArrow(deal, "bucket int, model binary")
    found = sides[0].groupBy("bucket").cogroup(sides[1].groupBy("bucket")).applyInArrow(meet, f"home int, sums binary, {_PART}")
    per = found.groupBy("home").applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return stored(per, short=True).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return score(docs, train(docs.filter("not held_out")))
