"""Tokens of two tokenizers lined up by bytes, and how often their tokens meet."""

from __future__ import annotations

import gc
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.bpe import byte_letters
from scoreloom.llm.common import aside, query, restored_names, slices, stored, table

# A pair of ids is one number: ids of B lie below this.
B_IDS = 1 << 15
# Pairs sent to every task, at most: those that most documents hold.
COMMON = 1 << 20
# Pairs a task counts before it hands the counts on.
HELD = 1 << 22
# Tokens compared one by one at the start of a diagonal, and at once at most.
SINGLE = 4
WIDEST = 4096


# Fixed value: how a byte-level tokenizer parts a text before it merges.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokens:
    """Byte-level BPE of a tokenizer file: ids of texts, and the bytes of each id.

    Ids of merged tokens rise in the order of the merges, so they are the ranks that another library
    merges by, several times as fast.
    """

    def __init__(self, path: str):
        from tiktoken import Encoding

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        own = {t: i for t, i in spec["model"]["vocab"].items() if t not in added}
        made = [own[x + y] for x, y in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        if made != sorted(made) or spec["normalizer"] or not spec["pre_tokenizer"].get("use_regex"):
            raise ValueError("not a byte-level tokenizer whose ids follow its merges")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in own.items()}
        self.bytes = [b""] * (max([*own.values(), *added.values()]) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        # without special tokens, their strings are plain text
        self.encode = Encoding("byte-level", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [self.encode(" " + t) for t in texts]


class PieceTokens:
    """Pieces of a model file with byte fallback: ids of texts, and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def aligned(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """Groups and links of two rising lists of end offsets that reach the same last offset.

    Groups come as runs (i, j, n): for n > 0, tokens i.. of A and j.. of B are one-to-one groups, n of
    them; for n < 0, one group begins at (i, j). Links of groups that aren't one-to-one are listed by
    places in A and in B; a one-to-one group is one link.

    While both lists agree on the diagonal j - i, a stretch is probed that doubles as long as it is
    equal throughout, and halves down to the first place where it isn't. There the group is walked
    token by token to the next common end, which sets the new diagonal.
    """
    runs: list[tuple[int, int, int]] = []
    of_a: list[int] = []
    of_b: list[int] = []
    i = j = 0
    n = len(a)
    while i < n:
        if a[i] == b[j]:
            start, shift, width = i, j - i, SINGLE
            i += 1
            near = min(i + SINGLE, n)
            while i < near and a[i] == b[i + shift]:
                i += 1
            while near <= i < n:
                width = min(2 * width, WIDEST)
                if a[i : i + width] == b[i + shift : i + shift + width]:
                    i = min(i + width, n)
                    continue
                while width > 1:
                    width >>= 1
                    if a[i : i + width] == b[i + shift : i + shift + width]:
                        i += width
                break
            runs.append((start, start + shift, i - start))
            j = i + shift
        else:
            runs.append((i, j, -1))
            x, y = a[i], b[j]
            while x != y:
                of_a.append(i)
                of_b.append(j)
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            of_a.append(i)
            of_b.append(j)
            i += 1
            j += 1
    return runs, of_a, of_b


def group_starts(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first places in A and in B of every group."""
    i, j, n = runs.T
    sizes = np.abs(n)
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(i, sizes) + step, np.repeat(j, sizes) + step


def group_ends(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of `n` tokens are the last of their group."""
    last = np.zeros(n, bool)
    last[np.r_[starts[1:], n] - 1] = True
    return last


class GroupTexts:
    """`a1,a2|b1;a3|b2,b3` from ids and groups: every id's text with the sign that may follow it."""

    def __init__(self, ids_a: int, ids_b: int):
        self.of_b = 2 * ids_a
        texts = [f"{i}{sign}" for n, signs in ((ids_a, ",|"), (ids_b, ",;")) for i in range(n) for sign in signs]
        self.texts = np.array(texts, object)

    def __call__(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        last_a, last_b = group_ends(at_a, len(a)), group_ends(at_b, len(b))
        # a token stands after all tokens of its own kind before it, and those of the other kind in
        # the groups before it, for B also in its own
        group_a, group_b = (np.cumsum(last) - last for last in (last_a, last_b))
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + at_b[group_a]] = 2 * a + last_a
        codes[np.arange(len(b)) + np.r_[at_a[1:], len(a)][group_b]] = self.of_b + 2 * b + last_b
        return "".join(self.texts[codes].tolist())[:-1]


class _Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        if len(self.b.bytes) > B_IDS:
            raise ValueError(f"ids of the second tokenizer reach {len(self.b.bytes)}, beyond {B_IDS}")
        if len(self.a.bytes) * B_IDS > 1 << 32:
            raise ValueError(f"ids of the first tokenizer reach {len(self.a.bytes)}, beyond {(1 << 32) // B_IDS}")
        self.size_a, self.size_b = (np.array([len(t) for t in x.bytes]) for x in (self.a, self.b))
        self.bytes_b = np.array(self.b.bytes, object)
        self.text = GroupTexts(len(self.a.bytes), len(self.b.bytes))

    def __call__(self, texts: list[str | None]) -> Iterator[tuple]:
        """Per text: numbers of tokens of A and B and of groups, the groups as text, and keys of all links."""
        some = [t for t in texts if t]
        tokens = iter(zip(some, self.a(some), self.b(some)))
        for text in texts:
            if not text:
                yield 0, 0, 0, None, np.zeros(0, np.int64)
                continue
            a, b = (np.fromiter(ids, np.int64, len(ids)) for ids in next(tokens)[1:])
            # a byte-level tokenizer gives every text back: it only joins neighbouring bytes
            whole = b" " + text.encode()
            if int(self.size_a[a].sum()) != len(whole) or b"".join(self.bytes_b[b].tolist()) != whole:
                yield 0, 0, 0, None, np.zeros(0, np.int64)
                continue
            found, of_a, of_b = aligned(np.cumsum(self.size_a[a]).tolist(), np.cumsum(self.size_b[b]).tolist())
            runs = np.fromiter(chain.from_iterable(found), np.int64, 3 * len(found)).reshape(-1, 3)
            at_a, at_b = group_starts(runs)
            one = np.repeat(runs[:, 2] > 0, np.abs(runs[:, 2]))
            link_a = np.concatenate([at_a[one], np.fromiter(of_a, np.int64, len(of_a))])
            link_b = np.concatenate([at_b[one], np.fromiter(of_b, np.int64, len(of_b))])
            yield len(a), len(b), len(at_a), self.text(a, b, at_a, at_b), a[link_a] * B_IDS + b[link_b]


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """`docs`, but for its text, with _n_a, _n_b, _n_groups, _n_links, _groups, and packed _pairs and _times.

    A group is what lies between two byte offsets where tokens of both end; _groups holds its ids as
    `a1,a2|b1;a3|b2,b3`, null without tokens. _pairs are the distinct id pairs a * B_IDS + b whose
    tokens overlap, ascending, as unsigned 32-bit numbers, _times how many links each has. Null and
    empty texts, and those that either tokenizer doesn't give back byte by byte, have no tokens. Texts
    are taken whole; one pass without a shuffle. Columns of any name are carried.
    """
    inner, names = aside(docs, "text")
    inner = inner.drop(names["text"])
    rest = [f for f in inner.schema.fields if f.name != "text"]
    added = T.StructType.fromDDL(
        "_n_a long, _n_b long, _n_groups long, _n_links long, _groups string, _pairs binary, _times binary"
    )
    schema = T.StructType([*rest, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _Aligner(path_a, path_b)
        for part in slices(batches, "text", 1 << 20):
            rows = []
            gc.disable()  # nothing here refers to itself, and there are very many small lists
            for n_a, n_b, n_groups, groups, keys in align(part.column("text").to_pylist()):
                pairs, times = np.unique(keys, return_counts=True)
                packed = [pairs.astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes()]
                rows.append((n_a, n_b, n_groups, len(keys), groups, *packed))
            gc.enable()
            types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in rest], *columns], names=schema.names)

    return inner.mapInArrow(run, schema).select(*restored_names(names, added.names, without=["text"]))


def pair_counts(groups: DataFrame) -> DataFrame:
    """Of every id pair: pair, n (documents that hold it linked), best (no pair of its A id has more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def counts() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for pairs in batch.column(0).to_pylist():
                held.append(np.frombuffer(pairs, np.uint32))
                n_held += len(held[-1])
                if n_held > HELD:
                    yield counts()
                    held, n_held = [], 0
        if held:
            yield counts()

    counts = groups.select("_pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    of_a = F.floor(F.col("pair") / B_IDS).cast("int")
    counts = stored(counts.withColumn("a", of_a), "pair_counts")
    # one row per id of A
    most = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(groups: DataFrame) -> DataFrame:
    """`token_groups` rows, but for _pairs and _times, with _n_best and _count_sum.

    _n_best counts a document's links whose pair has the highest count of its A id, _count_sum adds
    the counts of all its links. Counts are numbers of rows: rows that share a doc_id are documents of
    their own. The pairs of most documents, COMMON at most, go to every task; rows bring their other
    pairs to a join by pair, in which no pair is frequent.
    """
    inner, names = aside(groups, "_pairs", "_times")
    inner = inner.drop(names["_pairs"], names["_times"])
    names = {c: m for c, m in names.items() if c not in ("_pairs", "_times")}
    inner = stored(inner.withColumn("_row", F.monotonically_increasing_id()), "token_groups")
    counts = stored(pair_counts(inner), "pairs")
    # pairs by the size of their counts in steps of a quarter power of two: few rows
    level = F.floor(F.log2("n") * 4).cast("int").alias("level")
    levels = counts.groupBy(level).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    least, taken = None, 0
    for row in levels:
        taken += row["pairs"]
        if taken > COMMON:
            break
        least = row["least"]
    common = counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
    table_ = common.toArrow()  # COMMON rows at most
    pair = table_.column("pair").to_numpy()
    order = np.argsort(pair)
    lookup = groups.sparkSession.sparkContext.broadcast(
        (pair[order].astype(np.uint32), table_.column("n").to_numpy()[order], table_.column("best").to_numpy()[order])
    )
    rest = [f for f in inner.schema.fields if f.name not in ("_pairs", "_times")]
    schema = T.StructType([*rest, *T.StructType.fromDDL("_n_best long, _count_sum long, _other array<long>, _often array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = lookup.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            pairs = [np.frombuffer(x, np.uint32) for x in batch.column(batch.schema.get_field_index("_pairs")).to_pylist()]
            sizes = np.array([len(p) for p in pairs])
            flat = np.concatenate(pairs)
            times = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("_times")).to_pylist()), np.uint32).astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            n_best, count_sum = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(n_best, row[hit], times[hit] * best[at[hit]])
            np.add.at(count_sum, row[hit], times[hit] * n[at[hit]])
            cuts = np.cumsum(np.bincount(row[~hit], minlength=len(sizes)))[:-1]
            other = [np.split(x[~hit].astype(np.int64), cuts) for x in (flat, times)]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            columns += [pa.array(n_best), pa.array(count_sum), *[pa.array(x, pa.list_(pa.int64())) for x in other]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    added = ["_n_best", "_count_sum"]
    looked_up = inner.mapInArrow(run, schema)
    if taken <= COMMON:  # every pair is among the common ones
        return looked_up.select(*restored_names(names, added))
    looked_up = stored(looked_up, "looked_up")
    each = looked_up.select("_row", F.explode(F.arrays_zip("_other", "_often")).alias("x")).select(
        "_row", F.col("x._other").alias("pair"), F.col("x._often").alias("times")
    )
    rare = counts.where(F.col("n") < least) if least is not None else counts
    more = each.join(rare, "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_more_best"),
        F.sum(F.col("times") * F.col("n")).alias("_more_sum"),
    )
    return (
        looked_up.join(more, "_row", "left")
        .withColumn("_n_best", F.col("_n_best") + F.coalesce("_more_best", F.lit(0)))
        .withColumn("_count_sum", F.col("_count_sum") + F.coalesce("_more_sum", F.lit(0)))
        .select(*restored_names(names, added))
    )


@query("op13_token_alignment")
def op13(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = token_groups(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    hashed = rows.select(
        "doc_id",
        *[F.col(f"_{c}").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links")],
        F.coalesce(F.sha2(F.col("_groups").cast("binary"), 256), F.lit("")).alias("groups_sha256"),
        "_pairs",
        "_times",
    )
    return with_counts(hashed).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
        F.col("_n_best").alias("n_best"), F.col("_count_sum").alias("count_sum"),
    )
