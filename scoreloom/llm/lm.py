"""LM scoring by a hierarchical Pitman-Yor model.

Every word is the context of a restaurant whose dishes are the words after it; the end of a text is the
context of a text's first word. Their parent is the restaurant of all words: a table in a context is a
customer of it. Its base measure spells words: a restaurant for every context of up to ORDER characters,
whose parent drops the character furthest away, down to a uniform measure. A table of the word
restaurant is a customer of each spelling restaurant along the word, and a table there is one customer
of its parent.

Seating is sampled by Gibbs sweeps over all dishes of a level at once, each dish given the totals of
the sweep before. Predictions hang on a dish's number of tables alone, so a sweep seats all of its
customers anew by drawing that number: t tables for c customers in proportion to a**t * S(c, t), where
a is the weight of a new table and S the generalized Stirling numbers of the discount. Dishes are entries of
arrays that are dealt by hash, so a restaurant with a third of all customers lies in many of them, and a dish
costs no more for more customers than its number of tables varies. A pair of words met once has one table
in any seating, so sweeps read only the others. Probabilities are averaged over the kept sweeps.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.common import Words, crc_of_id, discard, mix64, query, slices, stored, table

ORDER = 3
#: Symbols of the spelling model. With contexts of ORDER symbols a table of it has 48**4 entries at
#: most: 21 MB.
SYMBOLS = 48
STRENGTH = 1.0
SWEEPS, BURN_IN = 4, 2
#: Stirling numbers of up to so many customers are kept as a table, others integrated at NODES places.
STIRLING, NODES = 256, 128
#: Words with at least this share of all tokens are sent to the tasks; there can be
#: no more than 65,536. The others are joined by hash, and none has a larger share.
FREQUENT = 1 / 65_536
END = b""  # no word is empty: the end of a text
#: Pairs of words a task counts before it hands them on.
PAIRS = 2_000_000


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each byte, and how many bytes share it. 0 is the edge of a word."""
    of = np.zeros(256, np.int64)
    for b in range(256):
        if ord("a") <= b <= ord("z"):
            of[b] = b - 96
        elif ord("0") <= b <= ord("9"):
            of[b] = 27
        elif b in b".,":
            of[b] = 28 + (b == ord(","))
        elif b < 128:
            of[b] = 30
        elif b >= 0xC0:
            of[b] = 31 if b == 0xC3 else 32
        else:
            of[b] = 33 + b % 15
    return of, np.bincount(of, minlength=SYMBOLS)


SYMBOL_OF, SHARING = _symbols()
LOG_SHARING = np.log(np.maximum(SHARING, 1))


class Spelling(NamedTuple):
    """Dense predictive probabilities of a symbol after ORDER others, and of every shorter context."""

    levels: tuple[np.ndarray, ...]  # levels[k]: P(symbol | k symbols before), flat
    tables: tuple[np.ndarray, ...]  # levels[k]: tables per context
    discounts: tuple[float, ...]

    @staticmethod
    def uniform() -> Spelling:
        flat = tuple(np.full(SYMBOLS ** (k + 1), 1 / SYMBOLS, np.float32) for k in range(ORDER + 1))
        return Spelling(flat, tuple(np.zeros(SYMBOLS**k) for k in range(ORDER + 1)), (0.5,) * (ORDER + 1))


def events(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The codes (ORDER symbols before, symbol) of all symbols of words, edges included, and the
    number of them per word."""
    lengths = np.array([len(w) for w in words], np.int64)
    padded = lengths + ORDER + 1
    flat = np.zeros(int(padded.sum()), np.int64)
    starts = np.cumsum(padded) - padded + ORDER
    at = np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    flat[at] = SYMBOL_OF[np.frombuffer(b"".join(words), np.uint8)]
    code = np.zeros(len(flat) - ORDER, np.int64)
    for k in range(ORDER + 1):
        code = code * SYMBOLS + flat[k : k + len(code)]
    n = lengths + 1
    pick = np.arange(int(n.sum())) + np.repeat(starts - ORDER - (np.cumsum(n) - n), n)
    return code[pick], n


def spelled(code: np.ndarray, n: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """The base probability of each word, given its `events`: its symbols, its end, and its bytes among those
    sharing a symbol. longest: P(symbol | ORDER symbols before)."""
    logs = np.log(longest[code].astype(np.float64)) - LOG_SHARING[code % SYMBOLS]
    return np.exp(np.add.reduceat(logs, np.cumsum(n) - n))


# ---- seating -------------------------------------------------------------------------------------


def reseat(sizes: list[int], customers: int, new: float, discount: float, draws: Sequence[float]) -> list[int]:
    """One dish after its customers have changed and some, two draws each, have been seated anew one by
    one. `tables_drawn` has the law that this tends to; tests hold it against this.

    Customers that came since the last sweep join the largest table; those that left come from it.
    """
    sizes = sorted(sizes, reverse=True) or [customers]
    sizes[0] += customers - sum(sizes)
    while sizes[0] < 1:  # more left than sat at the largest
        sizes = [sizes[0] + sizes[1], *sizes[2:]]
    if customers < 2:
        return sizes
    for i in range(0, len(draws), 2):
        r, k = draws[i] * customers, 0
        while k < len(sizes) - 1 and r >= sizes[k]:
            r -= sizes[k]
            k += 1
        sizes[k] -= 1
        if sizes[k] == 0:
            sizes[k] = sizes[-1]
            sizes.pop()
        u = draws[i + 1] * (new + customers - 1 - discount * len(sizes))
        if u < new:
            sizes.append(1)
            continue
        u, k = u - new, 0
        while k < len(sizes) - 1 and u >= sizes[k] - discount:
            u -= sizes[k] - discount
            k += 1
        sizes[k] += 1
    return sizes


@lru_cache(4)
def _log_stirling(discount: float) -> np.ndarray:
    """log S(c, t) at [c, t], up to STIRLING customers: S(c + 1, t) = S(c, t - 1) + (c - discount * t) * S(c, t)."""
    out = np.full((STIRLING + 1, STIRLING + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, STIRLING + 1)
    for c in range(1, STIRLING):
        with np.errstate(divide="ignore"):
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - discount * t, 0)))
    return out


def table_law(c: int, a: float, discount: float) -> tuple[int, np.ndarray]:
    """The probabilities of t, t + 1, ... tables for c customers, and this t; what they leave out is below 1e-9.

    S(c, t) / c! is the coefficient of z**c in ((1 - (1 - z)**d) / d)**t / t!, an integral through the
    point where the integrand of all t together is least on the axis: along a parabola around the cut of
    s = 1 - z, or along a circle around z = 0 if that is near.
    """
    low, high = -math.log(c) * 4 / (1 - discount) - 60, 0.0
    for _ in range(60):  # where a * s**(d - 1) = c / (1 - s), as a logarithm
        at = (low + high) / 2
        more = math.log(a) + (discount - 1) * at + math.log(max(-math.expm1(at), 1e-300)) > math.log(c)
        low, high = (at, high) if more else (low, at)
    z0, s0 = -math.expm1(low), max(math.exp(low), 1 / c)
    mean = -a / discount * math.expm1(discount * math.log(s0))
    spread = c * (1 + (1 - discount) * z0 / s0)  # the variance of all customers, if their number were open
    reach = 9 * math.sqrt(mean if s0 < 0.1 else max(mean - c * c / spread, 0.0)) + 30
    first, last = max(1, int(mean - reach)), min(c, int(mean + reach) + 1)
    if s0 < 0.1:
        theta = np.linspace(0, 6.5 / math.sqrt((1 - discount) * max(c * s0, 1.0)), NODES)
        z = 1 - s0 * (1 + 1j * theta) ** 2
        weight = s0 * (1 + 1j * theta) / z
    else:
        within = math.sqrt(max(spread - c * c / mean, 0.0))  # the same at a given number of tables
        theta = np.linspace(0, math.pi if within < 8 else min(math.pi, 20 / within), NODES)
        z = z0 * np.exp(1j * theta)
        weight = np.ones(NODES, complex)
        weight[-1] = 0.5
    each = -a / discount * np.expm1(discount * np.log1p(-z))
    start = first * np.log(each) - c * np.log(z)
    start = np.exp(start - start.real.max()) * weight
    start[0] /= 2
    steps = np.empty((last - first + 1, NODES), complex)
    steps[0] = start
    steps[1:] = each / np.arange(first + 1, last + 1)[:, None]
    p = np.cumprod(steps, 0).sum(1).real
    p = np.maximum(p, 0)
    return first, p / p.sum()


def _uniform(keys: np.ndarray, sweep: int) -> np.ndarray:
    """A number in [0, 1) that depends on the dish and the sweep alone: a retried task draws the same."""
    with np.errstate(over="ignore"):
        step = np.uint64(1 + sweep) * np.uint64(0x9E3779B97F4A7C15)
        return (mix64(mix64(keys.view(np.uint64)) + step) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def tables_drawn(customers: np.ndarray, new: np.ndarray, discount: float, draws: np.ndarray) -> np.ndarray:
    """The number of tables of many dishes after all their customers have been seated anew, a draw each."""
    out = np.minimum(customers, 1).astype(np.int64)
    new = np.maximum(new, 1e-300)  # the base probability of a very long word is 0
    below = 1
    for most in (4, 16, 64, STIRLING):
        rows = np.flatnonzero((customers > below) & (customers <= most))
        below = most
        for at in np.array_split(rows, -(-len(rows) * most // (1 << 20)) or 1):
            if len(at):
                logs = _log_stirling(discount)[customers[at], 1 : most + 1] + np.log(new[at])[:, None] * np.arange(1, most + 1)
                p = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), 1)
                out[at] = 1 + (p < draws[at, None] * p[:, -1:]).sum(1)
    for i in np.flatnonzero(customers > STIRLING).tolist():
        first, p = table_law(int(customers[i]), float(new[i]), discount)
        out[i] = first + min(int(np.searchsorted(np.cumsum(p), draws[i])), len(p) - 1)
    return out


# ---- the word restaurant -------------------------------------------------------------------------


class Totals(NamedTuple):
    tokens: int
    types: int
    customers: int
    tables: int
    discount: float
    pair_discount: float
    pairs: DataFrame | None = None  # (key, n, known, base, score, spelled) of every pair of words


def _probability(t: Totals, k: np.ndarray, tables: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The word restaurant's predictive probability of words, given their customers, tables and base probability."""
    new = base * (STRENGTH + t.discount * t.tables)
    return (np.maximum(k - tables * t.discount, 0.0) + new) / (STRENGTH + t.customers)


def _looked_up(rows: DataFrame, by: str, values: DataFrame, frequent: DataFrame) -> DataFrame:
    """`rows` with the `values` of the word `by`. Frequent words are sent to every task: a task would
    get all pairs of one."""
    sent = F.broadcast(frequent.withColumnRenamed("h", by))
    rest = rows.join(F.broadcast(frequent.select(F.col("h").alias(by))), by, "left_anti")
    return rows.join(sent, by).unionByName(rest.join(values.withColumnRenamed("h", by), by))


# ---- the spelling restaurants --------------------------------------------------------------------


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def _level_sweep(parent, tables, discount: float, order: int, sweep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, c = batch.column("code").to_numpy(), batch.column("c").to_numpy()
            above = parent.value[code % SYMBOLS**order] if order else np.full(len(code), 1 / SYMBOLS)
            new = (STRENGTH + discount * tables.value[code // SYMBOLS]) * above
            t = tables_drawn(c, new.astype(np.float64), discount, _uniform(code + order, sweep))
            yield pa.RecordBatch.from_arrays(
                [batch.column("code"), batch.column("c"), pa.array(t)],
                names=["code", "c", "t"],
            )

    return run


def _spelling_sweep(counts: DataFrame, model: Spelling, sweep: int) -> Spelling:
    """A sweep over the spelling restaurants, from the longest contexts (code, c) down; then what they predict."""
    sc = counts.sparkSession.sparkContext
    state, found = None, []
    for order in range(ORDER, -1, -1):
        counts = stored(counts, "customers")
        if state is not None:
            discard(state)
        ones, twos = counts.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
        discount = _discount(ones, twos)
        parent = sc.broadcast(model.levels[order - 1] if order else None)
        held = sc.broadcast(model.tables[order])
        state = stored(counts.mapInArrow(_level_sweep(parent, held, discount, order, sweep), "code long, c long, t long"), "seating")
        discard(counts)
        parent.destroy(), held.destroy()
        got = state.select("code", "c", "t").toArrow()  # at most SYMBOLS ** (order + 1) rows
        found.append((got.column("code").to_numpy(), got.column("c").to_numpy(), got.column("t").to_numpy(), discount))
        counts = state.groupBy((F.col("code") % SYMBOLS**order).alias("code")).agg(F.sum("t").alias("c")) if order else counts
    discard(state)
    levels, tables, discounts = [], [], []
    above = np.full(1, 1 / SYMBOLS)
    for order, (code, c, t, discount) in enumerate(reversed(found)):
        contexts = SYMBOLS**order
        total = np.bincount(code // SYMBOLS, c, contexts)
        tabled = np.bincount(code // SYMBOLS, t, contexts)
        wide = np.tile(above, SYMBOLS) if order else np.full(SYMBOLS, 1 / SYMBOLS)
        # an unseen context expects what its parent does
        p = np.repeat((STRENGTH + discount * tabled) / (STRENGTH + total), SYMBOLS) * wide
        p[code] += (c - discount * t) / (STRENGTH + total[code // SYMBOLS])
        levels.append(p.astype(np.float32))
        tables.append(tabled)
        discounts.append(discount)
        above = p
    return Spelling(tuple(levels), tuple(tables), tuple(discounts))


# ---- counts and documents ------------------------------------------------------------------------


def _tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


def _hashed(words: Sequence[bytes]) -> np.ndarray:
    """The hash of each word; that of the end is 0."""
    found = Words([w.decode() for w in words])
    out = np.zeros(len(words), np.uint64)
    out[found.doc] = found.hashes
    return out.view(np.int64)


def _pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return u ^ ((w << np.uint64(1)) | (w >> np.uint64(63)))


def _key_column() -> Column:
    w = F.col("w")
    return F.col("u").bitwiseXOR(F.shiftleft(w, 1).bitwiseOR(F.shiftrightunsigned(w, 63)))


def _token_pairs(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text of every token, and the hashes of the token before (the end, for the first) and of itself."""
    words = Words(texts, fold=True)
    w = np.insert(words.hashes, np.cumsum(words.counts), np.uint64(0))
    doc = np.repeat(np.arange(len(texts)), words.counts + 1)
    return doc, np.concatenate([np.zeros(1, np.uint64), w[:-1]]), w


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[tuple[np.ndarray, ...]] = []

    def added(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        u, w, c, n = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((w, u))
        u, w = u[order], w[order]
        first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
        return u[first], w[first], np.add.reduceat(c[order], first), np.add.reduceat(n[order], first)

    def out() -> pa.RecordBatch:
        u, w, c, n = added(kept)
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (u.view(np.int64), w.view(np.int64), c, n)], names=["u", "w", "c", "n"])

    for part in slices(batches, "text"):
        doc, u, w = _token_pairs(part.column("text").to_pylist())
        train = ~part.column("held").to_numpy(zero_copy_only=False).astype(bool)
        kept.append(added([(u, w, train[doc].astype(np.int64), np.ones(len(u), np.int64))]))
        if sum(len(x[0]) for x in kept) > PAIRS:
            yield out()
    if kept:
        yield out()


# ---- blocks of documents, shards of words, buckets of pairs ---------------------------------------
#
# Documents lie in blocks, whose tokens are numbers in the block's own list of words. A block sends each of its
# words once, to a shard of words, and each of its pairs once, to a bucket of pairs, and is told what was
# counted and seated in the same order. A sweep is two turns: shards tell the buckets about the words of pairs
# met more than once in training, in a fixed order; buckets draw these pairs' tables and tell the shards
# their sums, in the same order. What travels is packed: no pair and no word is a row.

#: Bytes of text in a block, tokens of all documents per bucket, and words of all blocks per shard.
BLOCK, BUCKET, SHARD = 4 << 20, 2_000_000, 300_000
#: Bytes of text that are hashed at once, and words that are spelled at once.
HASHED, SPELLED = 1 << 20, 1 << 16
#: Lowest bytes of a word's probability that a block isn't told: 28 bits are left, those of spelling have 24.
ROUGH = 3


class Layout(NamedTuple):
    """How words are dealt to shards, and pairs to buckets: by the word before, of heavy words also by the word."""

    buckets: int
    shards: int
    heavy: np.ndarray  # in order
    parts: np.ndarray  # buckets of each

    def shard(self, words: np.ndarray) -> np.ndarray:
        return ((mix64(words) >> np.uint64(20)) % np.uint64(self.shards)).astype(np.int64)

    def bucket(self, words: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        parts = np.ones(len(words), np.uint64)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, words), len(self.heavy) - 1)
            parts = np.where(self.heavy[at] == words, self.parts[at], parts)
        with np.errstate(over="ignore"):
            return ((mix64(words[u] + mix64(words)[w] % parts[u]) >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)


def _joined(column, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)


def _packed(values: np.ndarray, dtype: type, sizes: np.ndarray) -> pa.Array:
    """The values in runs of these sizes, as bytes."""
    raw, ends = values.astype(dtype).tobytes(), np.cumsum(sizes) * np.dtype(dtype).itemsize
    return pa.array([raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())], pa.binary())


def _squeezed(values: np.ndarray, drop: int = 0) -> bytes:
    """The values, byte by byte of all of them, without their `drop` lowest bytes."""
    raw = np.ascontiguousarray(values).reshape(-1).view(np.uint8).reshape(-1, values.itemsize)
    return zlib.compress(raw[:, drop:].T.tobytes(), 1)


def _unpacked(value: bytes, dtype: type, drop: int = 0) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zlib.decompress(value), np.uint8).reshape(size - drop, -1)
    out = np.zeros((planes.shape[1], size), np.uint8)
    out[:, drop:] = planes.T
    return out.view(dtype).reshape(-1)


def _rows(shape: str, rows: list[dict]) -> pa.Table:
    """Rows of a table of packed arrays; what they leave out is null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [field.split() for field in shape.split(", ")]
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields})


def _blocks(carry: Sequence[str]):
    """A row for each block: its documents, their tokens and training marks, and its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(iter([batch]), "text", BLOCK):
                tokens, hashes, starts, ends, flats, at = [], [], [], [], [], 0
                for piece in slices(iter([part.select(["text"])]), "text", HASHED):
                    words = Words(piece.column("text").to_pylist(), fold=True)
                    closes = np.cumsum(words.counts)  # the end stands there, a word of no bytes
                    tokens.append(words.counts + 1)
                    hashes.append(np.insert(words.hashes, closes, np.uint64(0)))
                    starts.append(np.insert(words.start + at, closes, 0))
                    ends.append(np.insert(words.end + at, closes, 0))
                    flats.append(words.flat)
                    at += len(words.flat)
                known, first, ids, often = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True, return_counts=True)
                # the end, then the most frequent words: small numbers
                order = np.lexsort((known, -often, known > 0))
                known, first, ids = known[order], first[order], np.argsort(order)[ids]
                flat = b"".join(flats).lower()
                spelt = b"\n".join([flat[a:b] for a, b in zip(np.concatenate(starts)[first].tolist(), np.concatenate(ends)[first].tolist())])
                rows = pa.StructArray.from_arrays([part.column(c) for c in carry], fields=[part.schema.field(c) for c in carry])
                values = (np.concatenate(tokens).astype(np.int32), ~part.column("held").to_numpy(zero_copy_only=False).astype(bool), ids.astype(np.int32))
                packed = [*map(_squeezed, values), zlib.compress(spelt, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.array([len(ids)]), pa.array([len(known)]), *(pa.array([x], pa.binary()) for x in packed)],
                    names=["block", "docs", "n", "m", "tokens", "train", "ids", "spelt"],
                )
                block += 1

    return run


def _words_of(row: dict) -> np.ndarray:
    """The hashes of a block's words; the end is the first of them."""
    return np.r_[np.zeros(1, np.uint64), Words([zlib.decompress(row["spelt"]).decode()]).hashes]


class Pairs(NamedTuple):
    """The pairs of a block, each once: its words' places, its training tokens and all; and the pair of each token."""

    words: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    n: np.ndarray
    at: np.ndarray
    order: np.ndarray  # the pairs by bucket
    sizes: np.ndarray  # of each bucket

    @staticmethod
    def of(row: dict, layout: Layout) -> Pairs:
        words, ids = _words_of(row), _unpacked(row["ids"], np.int32).astype(np.int64)
        train = np.repeat(_unpacked(row["train"], bool), _unpacked(row["tokens"], np.int32))
        # a text ends with the end, the first of the words: it stands before the next
        code, at, n = np.unique(np.r_[0, ids[:-1]] * len(words) + ids, return_inverse=True, return_counts=True)
        u, w = code // len(words), code % len(words)
        bucket = layout.bucket(words, u, w)
        return Pairs(words, u, w, np.bincount(at, train).astype(np.int64), n, at, np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=layout.buckets))


#: A block's words for a shard, or row -1 of what a shard has of all blocks; at: the places of a block's words.
VOCABULARY = "shard int, block long, at binary, h binary, c binary, n binary, spelt binary"


def _words_sent(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, ids = _words_of(row), _unpacked(row["ids"], np.int32)
                train = np.repeat(_unpacked(row["train"], bool), _unpacked(row["tokens"], np.int32))
                shard = layout.shard(h)
                order, sizes = np.argsort(shard, kind="stable"), np.bincount(shard, minlength=layout.shards)
                some = np.flatnonzero(sizes)
                names = zlib.decompress(row["spelt"]).split(b"\n")
                names = [names[i] for i in order.tolist()]
                ends = np.cumsum(sizes[some]).tolist()
                columns = [_packed(v[order], t, sizes[some]) for v, t in ((h, np.uint64), (np.bincount(ids, train), np.int32), (np.bincount(ids), np.int32))]
                spelt = pa.array([b"\n".join(names[a:b]) for a, b in zip([0, *ends], ends)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(np.full(len(some), row["block"])), *columns, spelt], names=["shard", "block", "h", "c", "n", "spelt"]
                )

    return run


def _counted(sent: pa.Table) -> pa.Table:
    h = _joined(sent.column("h"), np.uint64)
    sizes = np.array([len(x) // 8 for x in sent.column("h").to_pylist()])
    known, first, back = np.unique(h, return_index=True, return_inverse=True)
    c, n = (np.bincount(back, _joined(sent.column(x), np.int32)).astype(np.int32) for x in ("c", "n"))
    names = b"\n".join(sent.column("spelt").to_pylist()).split(b"\n")
    spelt = zlib.compress(b"\n".join([names[i] for i in first.tolist()]), 1)
    shard = sent.column("shard")[0].as_py()
    places = zip(sent.column("block").to_pylist(), np.split(back.astype(np.int32), np.cumsum(sizes)[:-1]))
    rows = [{"shard": shard, "block": block, "at": _squeezed(at)} for block, at in places]
    return _rows(VOCABULARY, [*rows, {"shard": shard, "block": -1, "h": known.tobytes(), "c": c.tobytes(), "n": n.tobytes(), "spelt": spelt}])


def _heavy(least: float):
    """(h, n) of the words met so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, n = np.frombuffer(row["h"], np.int64), np.frombuffer(row["n"], np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[n >= least]) for x in (h, n)], names=["h", "n"])

    return run


#: Pairs of a block for a bucket: their words, and per pair how far the place of the word before moved among them,
#: the place of the word, and how many are training tokens and how many are not.
SENT = "block long, bucket int, h binary, pairs binary"


def _sent(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p, out = Pairs.of(row, layout), []
                stops = np.cumsum(p.sizes)
                for bucket in np.flatnonzero(p.sizes).tolist():
                    at = p.order[stops[bucket] - p.sizes[bucket] : stops[bucket]]
                    mine, place = np.unique(np.r_[p.u[at], p.w[at]], return_inverse=True)
                    u, w = np.split(place, 2)
                    pairs = np.array([np.diff(u, prepend=0), w, p.c[at], p.n[at] - p.c[at]], np.int32)
                    out.append({"block": row["block"], "bucket": bucket, "h": p.words[mine].tobytes(), "pairs": _squeezed(pairs)})
                yield _rows(SENT, out).combine_chunks().to_batches()[0]

    return run


#: A row of a block (0 and up): the place `at` of each pair it sent among the bucket's repeated ones; -1 for
#: one met once in training, -2 for one met once among held-out rows. Row -1 holds the repeated pairs; as stored, c of
#: these, and of those met more than once in training the words u and each pair's places among them in w. Rows -2
#: are for the shards: the words u of all pairs, their sums sk, sb, k, b in c, and the words w of repeated pairs.
MET = "bucket int, block long, shard int, at binary, u binary, w binary, c binary, n binary, ones long, twos long"


def _heads(u: np.ndarray, w: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of pairs by shard; how many each shard has; the places among them of the words u and w."""
    known, place = np.unique(np.r_[u, w], return_inverse=True)
    shard = layout.shard(known)
    order = np.argsort(shard, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return known[order], np.bincount(shard, minlength=layout.shards), *np.split(rank[place], 2)


def _met(table: pa.Table, layout: Layout = Layout(1, 1, np.zeros(0, np.uint64), np.zeros(0, np.uint64))) -> pa.Table:
    u, w = _joined(table.column("u"), np.uint64), _joined(table.column("w"), np.uint64)
    sizes = np.array([len(x) // 4 for x in table.column("c").to_pylist()])
    _, first, back = np.unique(_pair_key(u, w), return_index=True, return_inverse=True)
    c, n = (np.bincount(back, _joined(table.column(x), np.int32)).astype(np.int64) for x in ("c", "n"))
    u, w, again = u[first], w[first], n > 1
    at = np.where(again, np.cumsum(again) - 1, c - 2).astype(np.int32)[back]
    bucket = table.column("bucket")[0].as_py()
    rows = [{"bucket": bucket, "block": b, "at": a} for b, a in zip(table.column("block").to_pylist(), _packed(at, np.int32, sizes).to_pylist())]
    del back, at
    packed = {x: v[again].tobytes() for x, v in (("u", u), ("w", w), ("c", c), ("n", n))}
    rows.append({"bucket": bucket, "block": -1, "ones": int((c == 1).sum()), "twos": int((c == 2).sum())} | packed)
    heads, held, _, _ = _heads(u[c > 1], w[c > 1], layout)
    seen = c > 0
    words, every, begins, ends = _heads(u[seen], w[seen], layout)
    once = c[seen] == 1
    sums = np.array([np.bincount(x, v, len(words)) for x, v in ((ends, once), (begins, once), (ends, None), (begins, None))]).astype(np.int32)
    some = np.flatnonzero(every)
    for shard, mine, theirs, a, b in zip(some.tolist(), _packed(words, np.uint64, every[some]).to_pylist(), _packed(heads, np.uint64, held[some]).to_pylist(), (np.cumsum(every) - every)[some], np.cumsum(every)[some]):
        rows.append({"bucket": bucket, "block": -2, "shard": shard, "u": mine, "w": theirs, "c": sums[:, a:b].tobytes()})
    return _rows(MET, rows)


def _gathered(layout: Layout):
    """`_met` of what blocks have sent, squeezed."""

    def run(sent: pa.Table) -> pa.Table:
        columns: dict[str, list[bytes]] = {"u": [], "w": [], "c": [], "n": []}
        for h, pairs in zip(sent.column("h").to_pylist(), sent.column("pairs").to_pylist()):
            words, (moved, w, c, held) = np.frombuffer(h, np.uint64), _unpacked(pairs, np.int32).reshape(4, -1)
            for x, v in (("u", words[np.cumsum(moved)]), ("w", words[w]), ("c", c), ("n", c + held)):
                columns[x].append(v.tobytes())
        table = pa.table({"bucket": sent.column("bucket"), "block": sent.column("block")} | {x: pa.array(v, pa.binary()) for x, v in columns.items()})
        del sent, columns
        rows = _met(table, layout).to_pylist()
        for row in rows:
            if row["at"] is not None:
                row["at"] = _squeezed(np.frombuffer(row["at"], np.int32))
            elif row["block"] == -2:
                row["c"] = _squeezed(np.frombuffer(row["c"], np.int32))
            else:
                c = np.frombuffer(row["c"], np.int64)
                heads, _, u, w = _heads(*(np.frombuffer(row[x], np.uint64)[c > 1] for x in ("u", "w")), layout)
                row |= {"u": heads.tobytes(), "w": _squeezed(np.array([u, w], np.int32)), "c": _squeezed(c.astype(np.int32)), "n": None}
        return _rows(MET, rows)

    return run


#: What a shard knows of its words, in row -1, and the places of the words each bucket (0 and up) asks for.
#: c, n: tokens that aren't held out, and all; sk, sb: pairs met once that the word ends, and begins; k, b: tables
#: of all pairs that it ends (its customers), and begins, one for each pair to begin with.
LEXICON = (
    "shard int, bucket int, at binary, h binary, c binary, n binary, spelt binary, sk binary, sb binary, k binary, b binary, "
    "tokens long, types long, customers long, ones long, twos long"
)


def _lexicon(key, counted: pa.Table, met: pa.Table) -> pa.Table:
    row = counted.to_pylist()[0]
    h, c = np.frombuffer(row["h"], np.uint64), np.frombuffer(row["c"], np.int32).astype(np.int64)
    sums, links = np.zeros((4, len(h)), np.int32), []
    for x in met.to_pylist():
        sums[:, np.searchsorted(h, np.frombuffer(x["u"], np.uint64))] += _unpacked(x["c"], np.int32).reshape(4, -1)
        if x["w"]:
            at = np.searchsorted(h, np.frombuffer(x["w"], np.uint64)).astype(np.int32)
            links.append({"shard": row["shard"], "bucket": x["bucket"], "at": at.tobytes()})
    k = sums[2]
    known = {x: row[x] for x in ("shard", "h", "c", "n", "spelt")} | {"bucket": -1} | {x: v.tobytes() for x, v in zip(("sk", "sb", "k", "b"), sums)}
    known |= {"tokens": int(c.sum()), "types": int((c > 0).sum()), "customers": int(k.sum()), "ones": int((k == 1).sum()), "twos": int((k == 2).sum())}
    return _rows(LEXICON, [known, *links])


#: Row -1: the words' customers, tables they begin, tables, and base probabilities; the same of the words a bucket (0
#: and up) asks for. Row -2: customers `counts` of the longest contexts `codes` of spelling.
TURN = "shard int, bucket int, k binary, b binary, t binary, base binary, codes binary, counts binary, customers long, seats long"


def _word_turn(longest, totals: Totals, sweep: int):
    """Draws the words' tables, given the tables of the pairs."""

    def run(key, lexicon: pa.Table, seated: pa.Table) -> pa.Table:
        lexicon = {r["bucket"]: r for r in lexicon.to_pylist()}
        row = lexicon.pop(-1)
        h, names = np.frombuffer(row["h"], np.int64), zlib.decompress(row["spelt"]).split(b"\n")
        k, b = (np.frombuffer(row[x if not sweep else f"s{x}"], np.int32).astype(np.int64) for x in ("k", "b"))
        for x in seated.to_pylist():
            at = np.frombuffer(lexicon[x["bucket"]]["at"], np.int32)
            ended, begun = np.frombuffer(x["drawn"], np.int32).reshape(2, -1)
            k[at] += ended
            b[at] += begun
        t, base, counts = np.zeros(len(h), np.int64), np.zeros(len(h)), np.zeros(SYMBOLS ** (ORDER + 1), np.int64)
        for i in range(0, len(h), SPELLED):
            part = slice(i, i + SPELLED)
            code, n = events(names[part])
            base[part] = spelled(code, n, longest.value)
            t[part] = tables_drawn(k[part], (STRENGTH + totals.discount * totals.tables) * base[part], totals.discount, _uniform(h[part], sweep))
            counts += np.bincount(code, np.repeat(t[part], n), len(counts)).astype(np.int64)
        codes = np.flatnonzero(counts)
        k, b, t = (v.astype(np.int32) for v in (k, b, t))
        packed = lambda bucket, at: {"shard": row["shard"], "bucket": bucket} | {x: v[at].tobytes() for x, v in (("k", k), ("b", b), ("t", t), ("base", base))}
        out = [packed(-1, slice(None)) | {"customers": int(k.sum(dtype=np.int64)), "seats": int(t.sum(dtype=np.int64))}]
        out.append({"shard": row["shard"], "bucket": -2, "codes": codes.tobytes(), "counts": counts[codes].tobytes()})
        if sweep < SWEEPS:
            out += [packed(bucket, np.frombuffer(x["at"], np.int32)) for bucket, x in lexicon.items()]
        return _rows(TURN, out)

    return run


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Customers of the longest contexts: one per table of a word for each of its symbols."""
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[x], np.int64)) for x in ("codes", "counts")], names=["code", "c"])


#: The tables drawn for the pairs met more than once in training, in row -1, and their sums by the words of a shard
#: (0 and up) that end the pairs and that begin them.
SEATED = "bucket int, shard int, drawn binary"


def _often(met: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs met more than once in training: their words, the places of u and w among these, and c."""
    row = met.to_pylist()[0]
    u, w = _unpacked(row["w"], np.int32).reshape(2, -1)
    c = _unpacked(row["c"], np.int32)
    return np.frombuffer(row["u"], np.uint64), u, w, c[c > 1].astype(np.int64)


def _pair_turn(totals: Totals, layout: Layout, sweep: int):
    """Draws the tables of pairs met more than once, given their words."""

    def run(key, met: pa.Table, told: pa.Table) -> pa.Table:
        heads, begins, ends, c = _often(met)
        sizes = np.bincount(layout.shard(heads), minlength=layout.shards)
        told = told.take(pc.sort_indices(told, [("shard", "ascending")]))
        k, b, t = (_joined(told.column(x), np.int32) for x in ("k", "b", "t"))
        a = b * totals.pair_discount + STRENGTH
        p = _probability(totals, k, t, _joined(told.column("base"), np.float64))
        drawn = tables_drawn(c, p[ends] * a[begins], totals.pair_discount, _uniform(_pair_key(heads[begins], heads[ends]), sweep))
        bucket, some = key[0].as_py(), np.flatnonzero(sizes)
        sums = np.array([np.bincount(x, drawn, len(k)) for x in (ends, begins)]).astype(np.int32)
        stops = np.cumsum(sizes)
        rows = [{"bucket": bucket, "shard": s, "drawn": sums[:, stops[s] - sizes[s] : stops[s]].tobytes()} for s in some.tolist()]
        return _rows(SEATED, [{"bucket": bucket, "shard": -1, "drawn": drawn.astype(np.int32).tobytes()}, *rows])

    return run


class Seated(NamedTuple):
    """What the sweeps leave: tables as above, those of every kept sweep, and the totals after each of these."""

    layout: Layout
    vocabulary: DataFrame
    met: DataFrame
    lexicon: DataFrame
    words: list[DataFrame]
    pairs: list[DataFrame]
    totals: list[Totals]
    unseen: list[float]  # the probability of all unseen words
    every: int


def _by_sweep(kept: list[DataFrame], *columns: str) -> DataFrame:
    out = [df.select(F.lit(i).alias("i"), *columns) for i, df in enumerate(kept)]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]


def _known(totals: list[Totals], states: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The words' probabilities and the tables they begin, by kept sweep."""
    rows = sorted(states.to_pylist(), key=lambda r: r["i"])
    k, b, t = ([np.frombuffer(r[x], np.int32) for r in rows] for x in ("k", "b", "t"))
    return np.array([_probability(x, *v, np.frombuffer(r["base"], np.float64)) for x, r, *v in zip(totals, rows, k, t)]), np.array(b)


def _mass(totals: list[Totals]):
    """The probability of all words seen in training, by kept sweep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                k, t = (np.frombuffer(r[x], np.int32) for x in ("k", "t"))
                p = _probability(totals[r["i"]], k, t, np.frombuffer(r["base"], np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([r["i"]], pa.int32()), pa.array([float(p[k > 0].sum())])], names=["i", "p"])

    return run


def _seated(blocks: DataFrame) -> Seated:
    """The model of documents in blocks."""
    sc = blocks.sparkSession.sparkContext
    every, named = (x or 0 for x in blocks.agg(F.sum("n"), F.sum("m")).first())
    layout = Layout(-(-every // BUCKET) or 1, -(-named // SHARD) or 1, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    sent = blocks.select("block", "ids", "train", "tokens", "spelt").mapInArrow(_words_sent(layout), "shard int, block long, h binary, c binary, n binary, spelt binary")
    vocabulary = stored(sent.groupBy("shard").applyInArrow(_counted, VOCABULARY), "vocabulary")
    if layout.buckets > 1:  # at most 65,536 words: no part of another is above an eighth of a bucket, or 1 / 65,536 of all
        share = max(every / (8 * layout.buckets), every * FREQUENT)
        heavy = vocabulary.where("block = -1").select("h", "n").mapInArrow(_heavy(share), "h long, n long").toArrow()
        h, n = (heavy.column(x).to_numpy() for x in ("h", "n"))
        order = np.argsort(h.view(np.uint64))
        layout = layout._replace(heavy=h.view(np.uint64)[order], parts=np.ceil(n[order] * (8 * layout.buckets / every)).astype(np.uint64))
    sent = blocks.select("block", "ids", "train", "tokens", "spelt").mapInArrow(_sent(layout), SENT)
    met = stored(sent.groupBy("bucket").applyInArrow(_gathered(layout), MET), "met")
    ones, twos = (x or 0 for x in met.agg(F.sum("ones"), F.sum("twos")).first())
    counted = vocabulary.where("block = -1").groupBy("shard")
    lexicon = stored(counted.cogroup(met.where("block = -2").select("shard", "bucket", "u", "w", "c").groupBy("shard")).applyInArrow(_lexicon, LEXICON), "lexicon")
    tokens, types, customers, word_ones, word_twos = (x or 0 for x in lexicon.agg(*map(F.sum, ("tokens", "types", "customers", "ones", "twos"))).first())
    totals = Totals(tokens, types, customers, types, _discount(word_ones, word_twos), _discount(ones, twos))
    again = met.where("block = -1").select("bucket", "u", "w", "c")
    mine = lexicon.select("shard", "bucket", "at", "h", "spelt", "sk", "sb", "k", "b")
    words, seated, spelling, kept = None, None, Spelling.uniform(), []
    for sweep in range(SWEEPS + 1):
        before = seated
        if words is not None:
            told = words.where("bucket >= 0").select("bucket", "shard", "k", "b", "t", "base")
            seated = stored(again.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_pair_turn(totals, layout, sweep), SEATED), "seated")
            if len(kept) == 0:
                discard(words, *([before] if before is not None else []))
        longest = sc.broadcast(spelling.levels[ORDER])
        drawn = blocks.sparkSession.createDataFrame([], SEATED) if seated is None else seated.where("shard >= 0")
        words = stored(mine.groupBy("shard").cogroup(drawn.groupBy("shard")).applyInArrow(_word_turn(longest, totals, sweep), TURN), "words")
        longest.destroy()
        customers, seats = words.agg(F.sum("customers"), F.sum("seats")).first()
        totals = totals._replace(customers=customers or 0, tables=seats or 0)
        if sweep > BURN_IN:
            kept.append((words, seated, totals))
        if sweep < SWEEPS:
            counts = words.where("bucket = -2").select("codes", "counts").mapInArrow(_codes, "code long, c long")
            spelling = _spelling_sweep(counts.groupBy("code").agg(F.sum("c").alias("c")), spelling, sweep)
    words, pairs, after = map(list, zip(*kept))
    mass = _by_sweep([df.where("bucket = -1") for df in words], "k", "t", "base").mapInArrow(_mass(after), "i int, p double")
    mass = {r["i"]: r["p"] for r in mass.groupBy("i").agg(F.sum("p").alias("p")).collect()}
    return Seated(layout, vocabulary, met, lexicon, words, pairs, after, [max(1.0 - mass.get(i, 0.0), 1e-300) for i in range(len(kept))], every)


def _states(s: Seated) -> DataFrame:
    """The words of the kept sweeps, and with i -1 what a shard knows of them: c in k, n in b, h in base."""
    known = s.lexicon.where("bucket = -1").select(F.lit(-1).alias("i"), "shard", F.col("c").alias("k"), F.col("n").alias("b"), F.col("spelt").alias("t"), F.col("h").alias("base"))
    return known.unionByName(_by_sweep([df.where("bucket = -1") for df in s.words], "shard", "k", "b", "t", "base"))


def _told(key, met: pa.Table, seated: pa.Table) -> pa.Table:
    """What each block is told of the pairs it sent: training tokens, and tables of every kept sweep."""
    samples = SWEEPS - BURN_IN
    block = met.column("block").to_numpy()
    c = np.r_[_unpacked(met.column("c").filter(pa.array(block == -1))[0].as_py(), np.int32), 0, 1]  # then what was met once
    values = np.repeat(np.minimum(c, 1)[:, None], samples + 1, 1)
    values[:, 0] = c
    for row in seated.to_pylist():
        values[np.flatnonzero(c > 1), row["i"] + 1] = np.frombuffer(row["drawn"], np.int32)
    values = values.astype(np.int32)
    rows = met.filter(pa.array(block >= 0))
    told = [_squeezed(values[_unpacked(at, np.int32)].T) for at in rows.column("at").to_pylist()]
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "told": pa.array(told, pa.binary())})


def _placed(totals: list[Totals]):
    """What each block is told of its words: training tokens, and tables they begin and probabilities of every kept sweep."""

    def run(key, places: pa.Table, states: pa.Table) -> pa.Table:
        i = states.column("i").to_numpy()
        c = _joined(states.column("k").filter(pa.array(i == -1)), np.int32)
        p, b = _known(totals, states.filter(pa.array(i >= 0)))
        b = np.r_[c[None], b]
        at = [_unpacked(x, np.int32) for x in places.column("at").to_pylist()]
        told = {"counts": [_squeezed(b[:, x]) for x in at], "p": [_squeezed(p[:, x], ROUGH) for x in at]}
        return pa.table({"block": places.column("block"), "shard": places.column("shard")} | {x: pa.array(v, pa.binary()) for x, v in told.items()})

    return run


def _scored(layout: Layout, totals: list[Totals], unseen: Sequence[float]):
    """The documents of a block, given what it is told of its words and pairs."""
    samples = len(totals)
    pair_discount = totals[0].pair_discount
    scale = float(np.log10(totals[0].tokens + 0.1 * (totals[0].types + 1)))

    def run(key, block: pa.Table, told: pa.Table) -> pa.Table:
        row = block.drop_columns(["docs"]).to_pylist()[0]
        p = Pairs.of(row, layout)
        words = told.filter(pc.is_valid(told.column("shard")))
        words = words.take(pc.sort_indices(words, [("shard", "ascending")]))
        back = np.argsort(np.argsort(layout.shard(p.words), kind="stable"))
        cw, *b = np.concatenate([_unpacked(x, np.int32).reshape(samples + 1, -1) for x in words.column("counts").to_pylist()], 1)[:, back]
        pw = np.maximum(np.concatenate([_unpacked(x, np.float64, ROUGH).reshape(samples, -1) for x in words.column("p").to_pylist()], 1)[:, back], 1e-300)
        pairs = told.filter(pc.is_valid(told.column("bucket")))
        pairs = pairs.take(pc.sort_indices(pairs, [("bucket", "ascending")]))
        sent = np.concatenate([_unpacked(x, np.int32).reshape(samples + 1, -1) for x in pairs.column("told").to_pylist()], 1)
        c, *ts = sent[:, np.argsort(p.order)]
        lumped = np.where(cw > 0, pw, np.asarray(unseen)[:, None])
        given = lambda word: np.log10(
            sum(np.maximum(c - t * pair_discount, 0.0) + (b[i] * pair_discount + STRENGTH)[p.u] * word[i][p.w] for i, t in enumerate(ts)) / samples / (cw[p.u] + STRENGTH)
        )
        known = cw[p.w] > 0
        tokens = _unpacked(row["tokens"], np.int32)
        of_docs = lambda value: np.add.reduceat(value[p.at], np.cumsum(tokens) - tokens)
        docs = block.column("docs").combine_chunks().flatten()
        out = {docs.type[i].name: column for i, column in enumerate(docs.flatten())}
        out |= {
            "_n_tokens": pa.array(tokens.astype(np.int64)),
            "_n_known": pa.array(of_docs(known.astype(np.int64))),
            "_train_tokens": pa.array(np.full(len(tokens), totals[0].tokens)),
            "_base": pa.array(of_docs(np.log10(cw[p.w] + 0.1)) - tokens * scale),
            "_score": pa.array(of_docs(given(lumped))),
            "_spelled": pa.array(of_docs(given(pw))),
        }
        return pa.table(out)

    return run


def _word_rows(totals: list[Totals]):
    def run(states: pa.Table) -> pa.Table:
        i = states.column("i").to_numpy()
        row = states.filter(pa.array(i == -1)).to_pylist()[0]
        p, b = _known(totals, states.filter(pa.array(i >= 0)))
        a = b * totals[0].pair_discount + STRENGTH
        listed = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(v.shape[1] + 1) * len(v), pa.int32()), pa.array(v.T.ravel()))
        c, n = (pa.array(np.frombuffer(row[x], np.int32).astype(np.int64)) for x in ("k", "b"))
        words = pa.array(zlib.decompress(row["t"]).split(b"\n"), pa.binary())
        return pa.table({"h": pa.array(np.frombuffer(row["base"], np.int64)), "word": words, "c": c, "n": n, "p": listed(p), "a": listed(a)})

    return run


def _pair_rows(key, met: pa.Table, seated: pa.Table) -> pa.Table:
    heads, u, w, _ = _often(met)
    u, w = heads[u], heads[w]
    rows = sorted(seated.to_pylist(), key=lambda r: r["i"])
    ts = np.array([np.frombuffer(r["drawn"], np.int32) for r in rows]).astype(np.int64)
    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * len(ts), pa.int32()), pa.array(ts.T.ravel()))
    return pa.table({"u": pa.array(u.view(np.int64)), "w": pa.array(w.view(np.int64)), "ts": listed})


def language_model(docs: DataFrame) -> tuple[DataFrame, Totals]:
    """(h, word, c, n, log10p, spelled) for every word of `docs` (text, held) whatever stands before it,
    and the model's totals with the probabilities of every pair of neighbouring words.

    c counts the rows that aren't held out, n all; END stands for the end of a text. log10p takes all
    unseen words as one symbol, which gets what the seen ones leave; spelled tells them apart.
    """
    docs = docs.select("text", "held")
    s = _seated(stored(docs.mapInArrow(_blocks(["held"]), _block_shape(T.StructType([docs.schema["held"]]))), "blocks"))
    words = stored(_states(s).groupBy("shard").applyInArrow(_word_rows(s.totals), "h long, word binary, c long, n long, p array<double>, a array<double>"), "words")
    seated = _by_sweep([df.where("shard = -1") for df in s.pairs], "bucket", "drawn")
    again = s.met.where("block = -1").select("bucket", "u", "w", "c").groupBy("bucket").cogroup(seated.groupBy("bucket")).applyInArrow(_pair_rows, "u long, w long, ts array<long>")
    pairs = stored(
        docs.mapInArrow(_pair_counts, "u long, w long, c long, n long").groupBy("u", "w").agg(F.sum("c").alias("c"), F.sum("n").alias("n")),
        "pairs",
    )
    samples = SWEEPS - BURN_IN
    mean = lambda value: sum((value(i) for i in range(1, samples)), value(0)) / samples
    p = lambda i: F.greatest(F.col("p")[i], F.lit(1e-300))
    lumped = lambda known: lambda i: F.when(known, p(i)).otherwise(F.lit(s.unseen[i]))
    # every pair: what stands before it tells the weight of a new table, the word how one is filled
    more = F.col("c") > 1
    met = pairs.where(~more).select("u", "w", "c", "n", F.array_repeat("c", samples).alias("ts")).unionByName(pairs.where(more).join(again, ["u", "w"]))
    before, at = words.select("h", F.col("c").alias("cu"), "a"), words.select("h", F.col("c").alias("cw"), "p")
    often = words.where(F.col("n") >= max(1.0, s.every * FREQUENT))
    both = _looked_up(
        _looked_up(met, "u", before, often.select("h", F.col("c").alias("cu"), "a")), "w", at, often.select("h", F.col("c").alias("cw"), "p")
    )
    tabled = lambda i: F.greatest(F.col("c") - F.col("ts")[i] * s.totals[0].pair_discount, F.lit(0.0))
    given = lambda word: F.log10(mean(lambda i: tabled(i) + F.col("a")[i] * word(i)) / (F.col("cu") + STRENGTH))
    scored = both.select(
        _key_column().alias("key"), "n", (F.col("cw") > 0).cast("int").alias("known"), F.log10(F.col("cw") + 0.1).alias("base"),
        given(lumped(F.col("cw") > 0)).alias("score"), given(p).alias("spelled"),
    )
    out = words.select("h", "word", "c", "n", F.log10(mean(lumped(F.col("c") > 0))).alias("log10p"), F.log10(mean(p)).alias("spelled"))
    return out, s.totals[-1]._replace(pairs=scored)


def _block_shape(carried: T.StructType) -> T.StructType:
    shape = T.StructType().add("block", "long").add("docs", T.ArrayType(carried)).add("n", "long").add("m", "long")
    for c in ("tokens", "train", "ids", "spelt"):
        shape = shape.add(c, "binary")
    return shape


def lm_scores(docs: DataFrame, held_out) -> DataFrame:
    """`docs` without its text, with _held, _n_tokens, _n_known, _train_tokens, _base, _score
    and _spelled.

    The model learns from the rows where `held_out` doesn't hold. A-Z are lower-cased; the tokens of
    a text are its words and one end, so null and empty texts are one token. _base is the smoothed
    unigram log10 probability, _score the model's, of each token after the one before it; both take all
    unseen words as one symbol. In _spelled every unseen word has its own probability. Equal rows score
    alike. If nothing is learned from, spelling is uniform. No rows give no rows.
    Columns of any name are carried; one that is named like an added one is replaced.
    """
    added = ("_held", "_n_tokens", "_n_known", "_train_tokens", "_base", "_score", "_spelled")
    names = {f"_carried_{i}": c for i, c in enumerate(docs.columns) if c != "text" and c not in added}
    keyed = docs.select(*[F.col(f"`{c}`").alias(m) for m, c in names.items()], held_out.alias("held"), "text")
    carried = T.StructType([keyed.schema[m] for m in (*names, "held")])
    blocks = stored(keyed.mapInArrow(_blocks([*names, "held"]), _block_shape(carried)), "blocks")
    s = _seated(blocks)
    # what nothing reads again goes before the next table is made
    seated = _by_sweep([df.where("shard = -1") for df in s.pairs], "bucket", "drawn")
    of_pairs = stored(
        s.met.where("block >= -1").select("bucket", "block", "at", "c").groupBy("bucket").cogroup(seated.groupBy("bucket")).applyInArrow(_told, "block long, bucket int, told binary"),
        "told",
    )
    discard(s.met, *s.pairs)
    places = s.vocabulary.where("block >= 0").select("shard", "block", "at")
    of_words = stored(places.groupBy("shard").cogroup(_states(s).groupBy("shard")).applyInArrow(_placed(s.totals), "block long, shard int, counts binary, p binary"), "placed")
    discard(s.vocabulary, s.lexicon, *s.words)
    told = of_words.unionByName(of_pairs, allowMissingColumns=True)
    out = T.StructType([*carried])
    for c in added[1:4]:
        out = out.add(c, "long")
    for c in added[4:]:
        out = out.add(c, "double")
    scored = blocks.drop("n", "m").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scored(s.layout, s.totals, s.unseen), out)
    return scored.select(*[F.col(m).alias(c) for m, c in names.items()], F.col("held").alias("_held"), *added[1:])


@query("op8_pitman_yor_lm")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs, crc_of_id(F.col("doc_id")) % 10 == 0).select(
        "doc_id",
        F.col("_held").alias("held_out"),
        F.col("_n_tokens").alias("n_tokens"),
        F.col("_n_known").alias("n_known"),
        F.col("_train_tokens").alias("train_tokens"),
        F.col("_base").alias("base_score"),
        F.col("_score").alias("score"),
        F.col("_spelled").alias("spelled_score"),
    )
