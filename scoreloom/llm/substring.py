"""Substring dedup: windows of words that occur earlier, found in compressed FM-indexes of shards.

Equal windows must meet, yet no shard may have to see every document. A window is dealt to a shard by
its minimizer, the smallest hash of its runs of MINIMIZER words, which equal windows share. Windows
next to each other mostly share it too, so they travel together as one segment of text. Segments whose
minimizer occurs once in the corpus can't repeat and stay where they are. Every shard builds an
FM-index of its distinct segments and streams them through it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.common import Words, aside, bitmap, has_bit, key_bucket, mix64, query, restored_names, slices, stored, table

MINIMIZER = 6
#: Windows of a segment at most. A run of windows with one minimizer is cut there; it is long only
#: where a text repeats itself.
SEGMENT = 64
#: A minimizer with more segments than this has its windows dealt out one by one, by their own hash.
HOT = 50_000
#: Bytes of text per shard, before all segments that can't repeat are left out.
SHARD_BYTES = 8 << 20
#: Segments a task remembers in order to send each content once.
REMEMBERED = 400_000
LAST = (1 << 63) - 1
#: Bytes of text taken at a time.
SLICE = 2 << 20


# ---- FM-index ------------------------------------------------------------------------------------


class WaveletMatrix:
    """Rank queries over a sequence of numbers: one packed bit vector per bit of the alphabet."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        v = values.astype(np.int64)
        first = np.zeros(sigma, np.int64)
        symbols = np.arange(sigma)
        for level in range(self.levels - 1, -1, -1):
            bit = (v >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.r_[packed, np.zeros(-len(packed) % 8 + 8, np.uint8)].view(np.uint64)
            self.words.append(packed)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(packed))].astype(np.int32))
            self.zeros.append(int(len(v) - bit.sum()))
            first = self._step(len(self.words) - 1, (symbols >> level) & 1, first)
            v = np.concatenate([v[bit == 0], v[bit == 1]])
        self.first = first

    def _step(self, k: int, bit: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.before[k][at] + np.bitwise_count(self.words[k][at] & below)
        return np.where(bit == 1, self.zeros[k] + ones, i - ones)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position i."""
        for k in range(self.levels):
            i = self._step(k, (symbol >> (self.levels - 1 - k)) & 1, i)
        return i - self.first[symbol]


class FmIndex:
    """A Burrows-Wheeler transform in a wavelet matrix, for patterns of up to `depth` symbols.

    Suffixes are put in the order of their first symbols by doubling: enough for searches that
    deep. `group` numbers the suffixes, in that order, by their first `depth` symbols.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        n = len(text)
        self.depth, self.n = depth, n
        ranks = {1: text.astype(np.int64)}
        span = 1
        while span < depth + 1:
            key = ranks[span] * (n + sigma + 1) + self._shifted(ranks[span], span)
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order] = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
            span *= 2
            ranks[span] = new
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.start = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))]
        same, at, part = np.zeros(n - 1, bool) | True, 0, span
        while at < depth:
            while part > depth - at:
                part //= 2
            r = self._shifted(ranks[part], at)[order]
            same &= r[1:] == r[:-1]
            at += part
        self.group = np.r_[0, np.cumsum(~same)]
        edges = np.flatnonzero(np.r_[True, ~same, True])
        self.low, self.high = edges[:-1], edges[1:]

    @staticmethod
    def _shifted(ranks: np.ndarray, by: int) -> np.ndarray:
        return np.r_[ranks[by:], np.full(min(by, len(ranks)), -1, np.int64)] + 1

    def matches(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of many patterns of the text side by side, from their last symbols on.

        The length matched grows by one symbol a step; beyond `depth` the last symbol is given up by
        widening the interval to its group. Returns every position where the statistic reaches
        `depth`, and its group: the interval of suffixes that match there.
        """
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n)
        places, groups = [], []
        alive = np.arange(len(starts))
        for step in range(1, int(lengths.max(initial=0)) + 1):
            alive = alive[lengths[alive] >= step]
            at = starts[alive] + lengths[alive] - step
            symbol = text[at]
            lo = self.start[symbol] + self.bwt.rank(symbol, low[alive])
            hi = self.start[symbol] + self.bwt.rank(symbol, high[alive])
            if step >= self.depth:
                g = self.group[lo]
                lo, hi = self.low[g], self.high[g]
                places.append(at)
                groups.append(g)
            low[alive], high[alive] = lo, hi
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(groups)


def judge_shard(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """The segments of a shard, each content once, with its first place and which of its windows
    start earlier somewhere (one bit per window)."""
    pdf = pdf.sort_values(["h", "dk", "pos"], kind="stable").drop_duplicates("h")
    codes: dict[bytes, int] = {}
    ids: list[int] = []
    sizes = []
    for segment in pdf["seg"]:
        words = segment.split()
        sizes.append(len(words))
        ids += [codes.setdefault(w, len(codes) + 1) for w in words]
        ids.append(0)
    text, lengths = np.array(ids, np.int64), np.array(sizes, np.int64)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    index = FmIndex(text, len(codes) + 1, window)
    place, group = index.matches(text, starts, lengths)
    segment = np.searchsorted(starts, place, "right") - 1
    dk = pdf["dk"].to_numpy()[segment]
    pos = pdf["pos"].to_numpy()[segment] + (place - starts[segment])
    order = np.lexsort((pos, dk, group))
    head = np.r_[True, np.diff(group[order]) != 0]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    earlier = (dk[order] != dk[order][first]) | (pos[order] != pos[order][first])
    repeats = np.zeros(len(text), bool)
    repeats[place[order]] = earlier
    masks = [
        np.packbits(repeats[s : s + n - window + 1]).tobytes() if repeats[s : s + n - window + 1].any() else None
        for s, n in zip(starts, lengths)
    ]
    return pd.DataFrame({"h": pdf["h"].to_numpy(), "first_dk": pdf["dk"].to_numpy(), "first_pos": pdf["pos"].to_numpy(), "mask": masks})


# ---- segments ------------------------------------------------------------------------------------


class _Segments:
    """The segments of a slice of documents, as flat arrays."""

    def __init__(self, texts: Sequence[str | None], window: int):
        self.words = Words(texts)
        w, counts = self.words.hashes, self.words.counts
        n, span = len(w), window - MINIMIZER + 1
        self.size = 0
        if n < window:
            return
        base = np.cumsum(counts) - counts
        with np.errstate(over="ignore"):
            grams = np.zeros(n - MINIMIZER + 1, np.uint64)
            for k in range(MINIMIZER):
                grams = mix64(grams * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(grams)])
            least, have = grams, 1
            while have * 2 <= span:
                least, have = np.minimum(least[:-have], least[have:]), have * 2
            windows = n - window + 1
            least = np.minimum(least[:windows], least[span - have : span - have + windows])
            doc = self.words.doc
            whole = doc[:windows] == doc[window - 1 :]
            new = np.r_[True, (least[1:] != least[:-1]) | (doc[1:windows] != doc[: windows - 1]) | (whole[1:] != whole[:-1])]
            run = np.flatnonzero(new)
            length = np.diff(np.r_[run, windows])
            ok = whole[run]
            run, length = run[ok], length[ok]
            # where the minimizer itself comes twice within a run, windows of the run may be equal
            last = run + length - 1
            at = np.r_[0, np.cumsum(grams[:windows] == least)]
            twice = at[last] - at[run] + sum((grams[last + k] == least[last]).astype(np.int64) for k in range(span)) > 1
            pieces = -(-length // SEGMENT)  # long runs in pieces
            self.weight = 1 + np.repeat(twice, pieces).astype(np.int64)
            start = np.repeat(run, pieces) + SEGMENT * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            self.windows = np.minimum(SEGMENT, np.repeat(run + length, pieces) - start)
            self.start, self.end = start, start + self.windows + window - 1
            self.m = least[start]
            self.doc = doc[start]
            self.pos = start - base[self.doc]
            self.powers = np.r_[np.uint64(1), np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))]
            self.inverse = np.r_[np.uint64(1), np.cumprod(np.full(n, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))]
            self.sums = np.r_[np.uint64(0), np.cumsum(mix64(w) * self.powers[:n])]
        self.size = len(start)
        self.window = window

    def content(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs of words."""
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def chosen(self, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """(segment's document, pos, windows, start, end, route, content) of all that may repeat."""
        bucket = key_bucket(self.m)
        kept, single = has_bit(shared, bucket), has_bit(hot, bucket)
        plain = np.flatnonzero(kept & ~single)
        split = np.flatnonzero(kept & single)
        n = self.windows[split]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pick = np.r_[plain, np.repeat(split, n)]
        off = np.r_[np.zeros(len(plain), np.int64), step]
        windows = np.r_[self.windows[plain], np.ones(len(step), np.int64)]
        start = self.start[pick] + off
        end = start + windows + self.window - 1
        h = self.content(start, end)
        route = np.r_[self.m[plain], h[len(plain) :]]
        return self.doc[pick], self.pos[pick] + off, windows, start, end, route, h


def _buckets(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            s = _Segments(part.column("text").to_pylist(), window)
            if s.size:
                b, at = np.unique(key_bucket(s.m).astype(np.int32), return_inverse=True)
                n = np.bincount(at, weights=s.weight).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(n)], names=["bucket", "n"])

    return run


def repeat_sketch(keyed: DataFrame, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps over hashed minimizers: those that occur twice or more, and those that are hot."""
    counts = stored(
        keyed.select("text").mapInArrow(_buckets(window), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1"),
        "minimizers",
    )
    return bitmap(counts.select("bucket")), bitmap(counts.where(F.col("n") > HOT).select("bucket"))


def _contents(window: int, sketch, shards: int):
    """Segments with their text: each content once per task, unless an earlier place turns up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        shared, hot = sketch.value
        for part in slices(batches, "text", SLICE):
            s = _Segments(part.column("text").to_pylist(), window)
            if not s.size:
                continue
            doc, pos, _, start, end, route, h = s.chosen(shared, hot)
            dk = part.column("dk").to_numpy()[doc]
            order = np.lexsort((pos, dk, h))
            order = order[np.r_[True, np.diff(h[order]) != 0]] if len(order) else order
            if len(seen) > REMEMBERED:
                seen.clear()
            keep = []
            for i, x, place in zip(order.tolist(), h[order].tolist(), zip(dk[order].tolist(), pos[order].tolist())):
                if x not in seen or place < seen[x]:
                    seen[x] = place
                    keep.append(i)
            pick = np.array(keep, np.int64)
            flat, first, last = s.words.flat, s.words.start[start[pick]], s.words.end[end[pick] - 1]
            texts = [flat[a:b] for a, b in zip(first.tolist(), last.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((route[pick] % np.uint64(shards)).astype(np.int32)),
                    pa.array(h[pick].view(np.int64)),
                    pa.array(dk[pick]),
                    pa.array(pos[pick].astype(np.int32)),
                    pa.array(texts, pa.binary()),
                ],
                names=["shard", "h", "dk", "pos", "seg"],
            )

    return run


def _places(window: int, sketch):
    """Every place of every segment that may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, hot = sketch.value
        for part in slices(batches, "text", SLICE):
            s = _Segments(part.column("text").to_pylist(), window)
            if not s.size:
                continue
            doc, pos, windows, _, _, _, h = s.chosen(shared, hot)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array(part.column("dk").to_numpy()[doc]),
                    pa.array(part.column("rk").to_numpy()[doc]),
                    pa.array(pos.astype(np.int32)),
                    pa.array(windows.astype(np.int32)),
                ],
                names=["h", "dk", "rk", "pos", "windows"],
            )

    return run


def _cut(window: int, schema: T.StructType, carry: Sequence[str], verbatim: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts, removed, kept = [], [], []
            spans = part.column("spans").to_pylist()
            for text, found in zip(part.column("text").to_pylist(), spans):
                words = (text or "").encode().split()
                edge = np.zeros(len(words) + 1, np.int32)
                for x in found or ():
                    n = x["windows"]
                    bits = np.unpackbits(np.frombuffer(x["mask"], np.uint8), count=n) if x["mask"] is not None else np.ones(n, np.uint8)
                    at = x["pos"] + np.flatnonzero(bits)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                counts.append(len(words))
                removed.append(int(gone.sum()))
                if verbatim and not gone.any():
                    kept.append(text)
                else:
                    kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
            columns = [part.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names
            )

    return run


def without_repeats(docs: DataFrame, window: int = 20, verbatim: bool = False) -> DataFrame:
    """`docs` with _n_words, _n_removed and _kept: its words without those of repeated windows.

    A window is `window` consecutive words of one document, compared word for word. Words covered by
    a window that also starts earlier go: in a smaller doc_id, or earlier in the same document. All
    windows are judged on the input. With `verbatim`, texts that lose nothing stay as they were written.
    A null text has no words; fewer words than a window are kept. A
    null id comes after all others. Rows that share an id count as one document: windows at the same
    place in them are not earlier than each other, so repeated rows fare alike. No rows give no rows.
    Texts and words may be of any length. Other columns are carried; one that is named like an added
    one is replaced.
    """
    spark = docs.sparkSession
    names = {c: f"_carried_{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("dk"),
        F.xxhash64("text").alias("rk"),
        F.col("text"),
    )
    sketch = spark.sparkContext.broadcast(repeat_sketch(keyed, window))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(12, int(total // SHARD_BYTES) + 1)
    texts = keyed.select("dk", "text")
    verdicts = stored(
        texts.mapInArrow(_contents(window, sketch, shards), "shard int, h long, dk long, pos int, seg binary")
        .groupBy("shard")
        .applyInPandas(lambda pdf: judge_shard(pdf, window), "h long, first_dk long, first_pos int, mask binary"),
        "repeats",
    )
    places = keyed.select("dk", "rk", "text").mapInArrow(_places(window, sketch), "h long, dk long, rk long, pos int, windows int")
    first = (F.col("dk") == F.col("first_dk")) & (F.col("pos") == F.col("first_pos"))
    spans = (
        places.join(verdicts, "h")
        .where(~first | F.col("mask").isNotNull())
        .groupBy("dk", "rk")
        .agg(F.collect_set(F.struct("pos", "windows", F.when(first, F.col("mask")).alias("mask"))).alias("spans"))
    )
    carried = [n for c, n in names.items() if c != "text"]
    joined = keyed.select("dk", "rk", "text", *carried).join(spans, ["dk", "rk"], "left").select(*carried, "text", "spans")
    schema = T.StructType(
        [
            *[joined.schema[n] for n in carried],
            T.StructField("_n_words", T.LongType()),
            T.StructField("_n_removed", T.LongType()),
            T.StructField("_kept", T.StringType()),
        ]
    )
    out = joined.mapInArrow(_cut(window, schema, carried, verbatim), schema)
    return out.select(*restored_names(names, ["_n_words", "_n_removed", "_kept"], without=["text"]))


def cut_documents(docs: DataFrame, window: int) -> DataFrame:
    """`docs` with repeated passages cut from their texts; n_chars, if there, follows the text."""
    inner, names = aside(docs, "doc_id", "text")
    out = without_repeats(inner, window, verbatim=True)
    fresh = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    return out.select(*[fresh.get(c, F.col(m)).alias(c) for c, m in names.items()])


@query("op3_substring_dedup")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, 20).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )
