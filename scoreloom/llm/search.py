"""Ranked lexical search over buckets of impact vectors, longest first."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import PARTIAL, partial, query, slices, stored, summed, table

# Text of the items that are searched for at a time, in bytes; their terms go to every task.
ITEM_BYTES = 8 << 20
# Entries of vectors in a bucket, at most, but for a single longer vector.
BUCKET = 2_000_000
# The longest vectors, this share of all, are searched first and give the others a score to reach.
FIRST = 1 / 32
# Coordinates of an item are summed until those left can add this share of the score to reach.
LEFT = 0.2
# Floating-point bounds are widened by this much; survivors are scored in integers.
WIDER = 1 + 1e-9

_LETTER = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)


def terms(text: str | None, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in runs of about `most` bytes: ASCII letters, folded, digits and all beyond ASCII."""
    data = (text or "").encode().translate(_LETTER)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + most)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class _Index(dict):
    """Numbers of terms; -1 for a term that no item has."""

    def __missing__(self, term: bytes) -> int:
        return -1


@dataclass
class Items:
    """Items to search for: ids, the numbers of their distinct terms, and all terms by number."""

    ids: list[int | None]
    terms: list[np.ndarray]
    index: _Index = field(default_factory=_Index)

    @classmethod
    def of(cls, rows: Sequence[tuple[int | None, str | None]]) -> Items:
        out = cls([], [])
        for item_id, text in rows:
            found = {t for run in terms(text) for t in run}
            out.ids.append(item_id)
            out.terms.append(np.array(sorted(out.index.setdefault(t, len(out.index)) for t in found), np.int64))
        return out


def term_weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(tf: np.ndarray, n_terms: np.ndarray, n: int, total: int) -> np.ndarray:
    """What an occurrence count adds per unit of a term's weight, in documents of `n_terms` terms."""
    m = 50 + (50 * n_terms * n) // max(total, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _counted(docs: DataFrame, items) -> DataFrame:
    """Per document: doc_id, n (its terms), at and tf (the items' terms it holds, and how often), packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = items.value.index
        size = max(1, len(index))
        for part in slices(batches, "text", 2 << 20):
            ids, counts = [], []
            for text in part.column("text").to_pylist():
                n = 0
                for words in terms(text):
                    ids.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
                    n += len(words)
                counts.append(n)
            flat = np.concatenate([*ids, np.zeros(0, np.int64)])
            doc = np.repeat(np.arange(len(counts)), counts)[flat >= 0]
            key, tf = np.unique(doc * size + flat[flat >= 0], return_counts=True)
            cuts = np.searchsorted(key, np.arange(1, len(counts)) * size)
            packed = [[x.astype(np.int32).tobytes() for x in np.split(a, cuts)] for a in (key % size, tf)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), *[pa.array(p, pa.binary()) for p in packed]],
                names=["doc_id", "n", "at", "tf"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, at binary, tf binary")


def _frequencies(counted: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("at")), minlength=size)
        yield partial(0, TaskContext.get().partitionId(), total)

    parts = counted.select("at").mapInArrow(run, PARTIAL)
    found = summed(parts, np.int64, max(1, counted.rdd.getNumPartitions()))
    return found.get(0, np.zeros(size, np.int64))


def _flat(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def _vectors(counted: DataFrame, n: int, total: int) -> DataFrame:
    """Impact vectors of the documents that hold any term, each with its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            tf = _flat(batch.column("tf")).astype(np.int64)
            sizes = np.array([len(x) // 4 for x in batch.column("tf").to_pylist()])
            value = impacts(tf, np.repeat(batch.column("n").to_numpy(), sizes), n, total)
            cuts = np.cumsum(sizes)[:-1]
            squares = np.bincount(np.repeat(np.arange(len(sizes)), sizes), (value * value).astype(float), len(sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("at"),
                    pa.array([x.astype(np.int32).tobytes() for x in np.split(value, cuts)], pa.binary()),
                    pa.array(np.sqrt(squares)),
                ],
                names=["doc_id", "at", "value", "length"],
            )

    rows = counted.where(F.octet_length("at") > 0)
    return rows.mapInArrow(run, "doc_id long, at binary, value binary, length double")


class Best:
    """The k best documents of every item so far, and the score that another one has to reach."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k = k
        self.floors = floors.copy()
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3 for _ in floors]

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, missing: np.ndarray) -> None:
        good = (score > 0) & (score >= self.floors[item])
        if not good.any():
            return
        s, d, m = [np.concatenate([a, b[good]]) for a, b in zip(self.found[item], (score, doc, missing))]
        order = np.lexsort((d, m, -s))[: self.k]
        self.found[item] = (s[order], d[order], m[order])
        if len(order) == self.k:
            self.floors[item] = max(self.floors[item], s[order[-1]])


class Bucket:
    """Impact vectors of similar length: by row, and turned around by coordinate."""

    def __init__(self, doc, missing, lengths, sizes, at, value, n_terms: int):
        self.doc, self.missing, self.lengths = doc, missing, lengths
        self.at, self.value = at, value.astype(np.int64)
        self.sizes, self.first = sizes, np.cumsum(sizes) - sizes
        order = np.argsort(at, kind="stable")
        self.rows = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.by_term = self.value[order].astype(float)
        self.ends = np.cumsum(np.bincount(at, minlength=n_terms))
        self.starts = np.r_[0, self.ends[:-1]]
        self.peak = np.zeros(n_terms)
        held = np.flatnonzero(self.ends > self.starts)
        if len(held):
            self.peak[held] = np.maximum.reduceat(self.by_term, self.starts[held])

    def search(self, item: int, at: np.ndarray, weight: np.ndarray, dense: np.ndarray, best: Best) -> None:
        """Adds the documents of this bucket that are among the item's best.

        `at` and `weight` hold the item's coordinates, greatest first. No score exceeds the product of
        lengths, so the whole bucket may be left out. Inside, coordinates are summed until the bucket's
        peaks and the lengths of what is left can't reach much of the floor; documents whose sum and
        bound for the rest stay below it are left out, all others scored over all coordinates.
        """
        floor = max(int(best.floors[item]), 1)
        if math.sqrt(float((weight * weight).sum())) * self.lengths.max() * WIDER < floor:
            return
        w = weight.astype(float)
        tail = lambda x: np.cumsum(x[::-1])[::-1]
        rest_length = np.r_[np.sqrt(tail(w * w)), 0.0]
        rest_peak = np.r_[tail(w * self.peak[at]), 0.0]
        rest = np.minimum(rest_length * self.lengths.max(), rest_peak)
        used = int(np.argmax(rest <= LEFT * floor)) if floor > 1 else len(at)
        sums, squares = np.zeros(len(self.doc)), np.zeros(len(self.doc))
        for t, x in zip(at[:used].tolist(), w[:used].tolist()):
            a, b = self.starts[t], self.ends[t]
            rows, value = self.rows[a:b], self.by_term[a:b]
            sums[rows] += x * value
            squares[rows] += value * value
        left = np.sqrt(np.maximum(self.lengths**2 * WIDER - squares, 0.0)) * rest_length[used]
        bound = (sums + np.minimum(left, rest_peak[used])) * WIDER
        pick = np.flatnonzero(bound >= floor)
        if len(pick) == 0:
            return
        sizes = self.sizes[pick]
        start = np.cumsum(sizes) - sizes
        entry = np.repeat(self.first[pick] - start, sizes) + np.arange(int(sizes.sum()))
        score = np.add.reduceat(dense[self.at[entry]] * self.value[entry], start)
        best.add(item, score, self.doc[pick], self.missing[pick])


def _buckets(batches: Iterator[pa.RecordBatch], n_terms: int) -> Iterator[Bucket]:
    """The vectors in runs of at most BUCKET entries."""
    held: list[pa.RecordBatch] = []
    entries = 0
    for part in slices(batches, "at", BUCKET):
        more = sum(len(x) for x in part.column("at").to_pylist()) // 4
        if held and entries + more > BUCKET:
            yield _bucket(held, n_terms)
            held, entries = [], 0
        held.append(part)
        entries += more
    if held:
        yield _bucket(held, n_terms)


def _bucket(parts: list[pa.RecordBatch], n_terms: int) -> Bucket:
    rows = pa.Table.from_batches(parts).combine_chunks()
    doc = rows.column("doc_id").combine_chunks()
    at = rows.column("at").to_pylist()
    value = np.frombuffer(b"".join(rows.column("value").to_pylist()), np.int32)
    return Bucket(
        doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
        rows.column("length").to_numpy(), np.array([len(x) // 4 for x in at]),
        np.frombuffer(b"".join(at), np.int32), value, n_terms,
    )


def _searched(vectors: DataFrame, items, weights, floors, k: int) -> DataFrame:
    """The k best documents of every item among those of each task that reach the item's floor."""
    schema = "item int, item_id long, doc_id long, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = items.value, weights.value
        best = Best(floors.value, k)
        order = [t[np.argsort(-weight[t], kind="stable")] for t in asked.terms]
        dense = np.zeros(max(1, len(weight)), np.int64)
        for bucket in _buckets(batches, len(weight)):
            for i, at in enumerate(order):
                if len(at):
                    dense[at] = weight[at]
                    bucket.search(i, at, weight[at], dense, best)
                    dense[at] = 0
        for i, (score, doc, missing) in enumerate(best.found):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(score), i, np.int32)), pa.array([asked.ids[i]] * len(score), pa.int64()),
                        pa.array(doc, mask=missing.astype(bool)), pa.array(score),
                    ],
                    names=["item", "item_id", "doc_id", "score"],
                )

    longest_first = vectors.repartitionByRange(F.desc("length"), F.asc("doc_id"))
    return longest_first.sortWithinPartitions(F.desc("length")).mapInArrow(run, schema)


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The `k` documents of `docs` that score highest for each row of `items`: item_id, rank, doc_id, score.

    Equal scores follow doc_id, null last; rows that repeat are documents of their own, and so are
    repeated items. Null, empty and wordless texts have no terms and find nothing. Other columns of
    either table are not looked at. Texts are taken whole, in runs of a megabyte however long.

    Items are searched for in blocks of bounded text, all with the same number of passes. Documents
    become vectors of impacts over the items' terms, ordered by length over all tasks and cut into
    buckets. The longest ones are searched first. They give every item a score to reach, by which
    later buckets are left out whole or filtered coordinate by coordinate; what remains is scored in
    integers. A task returns at most `k` rows an item. The order by length is also one by doc_id, so
    equal vectors spread over tasks.
    """
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-n_bytes // ITEM_BYTES) or 1
    out = []
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = part.select(F.col("item_id").cast("long"), "text").collect()  # a block of bounded text
        out.append(_ranked_block(docs, Items.of([tuple(r) for r in rows]), k))
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union


def _ranked_block(docs: DataFrame, asked: Items, k: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    items = sc.broadcast(asked)
    counted = stored(_counted(docs, items), "term_counts")
    n, total = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    df = _frequencies(counted, max(1, len(asked.index)))
    weights = sc.broadcast(term_weights(n, df))
    vectors = stored(_vectors(counted, n, total or 1), "vectors")
    cut = vectors.agg(F.percentile_approx("length", 1 - FIRST)).first()[0] or 0.0
    none = np.zeros(len(asked.ids), np.int64)
    longest = _searched(vectors.where(F.col("length") >= cut), items, weights, sc.broadcast(none), k)
    first = stored(_top(longest, k), "longest")
    floors = none.copy()
    for row in first.where(F.col("rank") == k).select("item", "score").toLocalIterator():
        floors[row["item"]] = row["score"]
    others = _searched(vectors.where(F.col("length") < cut), items, weights, sc.broadcast(floors), k)
    rows = first.drop("rank").unionByName(others)
    return _top(rows, k).select("item_id", "rank", "doc_id", "score")


@query(
    "op12_ranked_search",
    r"""WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (
  SELECT DISTINCT row, item_id, term FROM (SELECT row_number() OVER () AS row, item_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT row, count(*) AS n FROM d GROUP BY row),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, n_docs),
s AS (
  SELECT i.row, item_id, tf.row AS doc_row, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN w USING (term) JOIN n ON n.row = tf.row, whole GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank FROM s WHERE score > 0)
WHERE rank <= 50""",
)
def op12(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
