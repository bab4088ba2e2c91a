"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups that its links make.

Shingles are put in one order for all documents, rare ones first. Two sets of Jaccard similarity t or
more share at least l of the first n - ceil(t * n) + l shingles of each, for every l. Each document
takes the l that makes its own candidates cheapest, and a pair must share as many as the smaller of
its two l's before it is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import (
    PARTIAL,
    Words,
    aside,
    bitmap,
    discard,
    has_bit,
    key_bucket,
    mix64,
    partial,
    query,
    restored_names,
    slices,
    stored,
    summed,
    table,
)
from scoreloom.llm.components import components

#: Counters of the frequency sketch, a byte each: 4 MB, whatever the corpus. Shingles that share a counter seem
#: more frequent than they are, which changes their order, never a result.
SKETCH = 1 << 22
SKETCH_BLOCK = 1 << 16
#: The most shingles a pair may be asked to share before it is verified.
MOST_MATCHES = 8
#: Verifying a candidate costs as much as this many entries of the prefix index.
VERIFY_COST = 20.0
#: Lists of a shingle longer than this are first thinned, in cells of about this many documents.
LIST = 32
CELL = 64
THINNING = 2
#: Members and probes that one comparison task holds at a time.
MEMBERS, PROBES = 256, 1024
LAST = (1 << 63) - 1
#: Groups whose sizes are sent to every task, at most; those of more groups are joined by shuffle.
SMALL_GROUPS = 500_000
#: Bytes of text taken at a time.
SLICE = 2 << 20
CODE = 8.0
OCCURRENCES = 2.0 ** (np.arange(256) / CODE) - 1
ALL_MATCHES = np.arange(1, MOST_MATCHES + 1)


def set_key(s: np.ndarray) -> int:
    """Names a set by its content; copies share it."""
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---- frequencies ---------------------------------------------------------------------------------


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (mix64(shingles) & np.uint64(SKETCH - 1)).astype(np.int64)


def _summaries(n: int):
    """Every row's set size and node, and at the end of a task its share of the frequency sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for part in slices(batches, "text", SLICE):
            sets = Words(part.column("text").to_pylist(), fold=True).shingles(n)
            counts += np.bincount(_counter(np.concatenate(sets)), minlength=SKETCH).astype(np.uint32)
            keys = [_signed(set_key(s)) if len(s) else None for s in sets]
            none = [None] * len(sets)
            yield pa.RecordBatch.from_arrays(
                [part.column("dk"), part.column("rk"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.int32()), pa.array(none, pa.binary())],
                names=["dk", "rk", "size", "node", "key", "part", "value"],
            )
        for b in range(SKETCH // SKETCH_BLOCK):
            block = counts[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK]
            if block.any():
                share = partial(b, TaskContext.get().partitionId(), block.astype(np.uint64))
                none = pa.array([None], pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, *share.columns], names=["dk", "rk", "size", "node", "key", "part", "value"])

    return run


def frequencies(parts: DataFrame, tasks: int) -> np.ndarray:
    """In how many documents each counter's shingles occur, as codes: eighths of a power of two."""
    code = lambda total: np.minimum(np.round(CODE * np.log2(1.0 + total)), 255).astype(np.uint8)
    codes = np.zeros(SKETCH, np.uint8)
    for b, block in summed(parts, np.uint64, tasks, code).items():
        codes[b * SKETCH_BLOCK : (b + 1) * SKETCH_BLOCK] = block
    return codes


# ---- prefixes ------------------------------------------------------------------------------------


def prefix(s: np.ndarray, codes: np.ndarray, noise: int, t: float) -> tuple[np.ndarray, int]:
    """The shingles of a set to index, and how many of them a pair must share.

    Reading the lists of a prefix costs the sum of its frequencies; at most that sum over l documents
    share l of its shingles, each to be verified. The l of least cost is taken.
    """
    n = len(s)
    seen = codes[_counter(s)]
    order = np.argsort(seen, kind="stable")  # sets are sorted, so ties are in the order of hashes
    cost = np.cumsum(np.maximum(OCCURRENCES[seen[order]] - OCCURRENCES[noise], 1.0))
    base = n - int(np.ceil(t * n - 1e-9))
    matches = ALL_MATCHES[: min(MOST_MATCHES, n - base)]
    spent = cost[base + matches - 1]
    best = int(matches[np.argmin(spent * (1 + VERIFY_COST / matches))])
    return s[order[: base + best]], best


def _prefixes(n: int, t: float, sketch, shared):
    """Index entries (shingle, node, size, matches, place in the order): of all shingles as buckets with their number if
    `shared` is None, else of those whose bucket is shared. A set is indexed once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        codes = sketch.value
        noise = int(np.median(codes))
        bits = shared.value if shared is not None else None
        for part in slices(batches, "text", SLICE):
            if len(done) > 1_000_000:
                done.clear()
            tokens, nodes, sizes, need = [], [], [], []
            for s in Words(part.column("text").to_pylist(), fold=True).shingles(n):
                key = set_key(s)
                if len(s) == 0 or key in done:
                    continue
                done.add(key)
                head, matches = prefix(s, codes, noise, t)
                tokens.append(head)
                nodes.append(key)
                sizes.append(len(s))
                need.append(matches)
            if not tokens:
                continue
            flat = np.concatenate(tokens)
            bucket = key_bucket(flat)
            if bits is None:
                b, c = np.unique(bucket.astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(c.astype(np.int64))], names=["bucket", "n"])
                continue
            on = has_bit(bits, bucket)
            each = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])[on]
            place = np.concatenate([np.arange(len(x)) for x in tokens])[on]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(flat[on].view(np.int64)),
                    pa.array(np.array(nodes, np.uint64).view(np.int64)[each]),
                    pa.array(np.array(sizes, np.int32)[each]),
                    pa.array(np.array(need, np.int32)[each]),
                    pa.array(place.astype(np.int32)),
                ],
                names=["token", "node", "size", "need", "place"],
            )

    return run


# ---- verification --------------------------------------------------------------------------------


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare(n: int, percent: int):
    """Rows sorted by place, members before probes: one link for every probe that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, members = None, []
        for part in slices(batches, "text", SLICE):
            out = []
            sets = Words(part.column("text").to_pylist(), fold=True).shingles(n)
            keys = list(zip(*(part.column(c).to_pylist() for c in ("target", "block", "chunk"))))
            for key, probe, node, s in zip(keys, part.column("probe").to_pylist(), part.column("node").to_pylist(), sets):
                if key != place:
                    place, members = key, []
                if not probe:
                    members.append((node, s))
                    continue
                for other, m in members:
                    if other != node and linked(s, m, percent):
                        out.append((node, other))
                        break
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["src", "dst"]
            )

    return run


def _within(n: int, percent: int):
    """Rows sorted by cell: links that connect what is linked within a cell, none twice over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, members, root = None, [], []
        for part in slices(batches, "text", SLICE):
            out = []
            sets = Words(part.column("text").to_pylist(), fold=True).shingles(n)
            keys = list(zip(part.column("target").to_pylist(), part.column("block").to_pylist()))
            for key, node, s in zip(keys, part.column("node").to_pylist(), sets):
                if key != cell:
                    cell, members, root = key, [], []
                own = len(members)
                root.append(own)
                for i, (other, m) in enumerate(members):
                    if root[i] != root[own] and other != node and linked(s, m, percent):
                        out.append((node, other))
                        root = [root[own] if r == root[i] else r for r in root]
                members.append((node, s))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["src", "dst"]
            )

    return run


def thinned(texts: DataFrame, nodes: DataFrame, lists: DataFrame, links: DataFrame | None, n: int, percent: int, step: int) -> DataFrame | None:
    """Links found by one round over the long lists (token, node, target) that span several groups.

    Each document goes with one of its lists, the same for documents that share them, into one cell
    of it, and a cell is compared all with all: every text travels once, and groups of near copies
    grow together however many they are. None if there is nothing to do.
    """
    several = lists.groupBy("token").agg(F.min("target").alias("a"), F.max("target").alias("b")).where("a <> b").select("token")
    chosen = lists.join(several, "token").groupBy("node").agg(F.min_by("token", F.xxhash64("token", F.lit(step))).alias("target"))
    chosen = stored(chosen, "chosen")
    if chosen.isEmpty():
        discard(chosen)
        return None
    sizes = chosen.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks"))
    cells = chosen.join(sizes, "target").select(
        "target", F.pmod(F.xxhash64("node", F.lit(step)), F.col("blocks")).cast("int").alias("block"), "node"
    )
    roles = stored(cells.join(nodes, "node"), "roles")
    wanted, bits = _with_texts(texts, roles)
    rows = wanted.select("target", "block", "node", "text")
    shuffles = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(shuffles, "target", "block").sortWithinPartitions("target", "block")
    found = dealt.mapInArrow(_within(n, percent), "src long, dst long")
    out = stored(found if links is None else links.union(found), "links")
    bits.destroy()
    discard(chosen, roles, *([] if links is None else [links]))
    return out


def _with_texts(texts: DataFrame, roles: DataFrame):
    """`roles` (dk, rk, ...) with their texts; other texts are left out before anything is shuffled, by
    a bitmap that comes along and has to be destroyed after use."""
    wanted = roles.select("rk").distinct().mapInArrow(_as_buckets, "bucket int")
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(wanted))
    return texts.mapInArrow(_only(bits, "rk"), texts.schema).join(roles, ["dk", "rk"]), bits


def _only(bits, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(column).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(has_bit(bits.value, key_bucket(keys))))

    return run


def verified(texts: DataFrame, nodes: DataFrame, probes: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (src, dst) of probes (node, target) with the members (node, target) of their targets.

    A target's members are dealt out in blocks and its probes in chunks, so a large target is many
    bounded comparisons. Whole texts travel: they are half as large as their shingles.
    """
    spark = texts.sparkSession
    sizes = members.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    asked = probes.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / PROBES).cast("int").alias("chunks"))
    split = stored(sizes.join(asked, "target"), "split")
    slot = lambda by: F.pmod(F.xxhash64("node", F.lit(7)), F.col(by)).cast("int")
    each = lambda by: F.explode(F.sequence(F.lit(0), F.col(by) - 1))
    roles = stored(
        members.join(split, "target")
        .select("target", slot("blocks").alias("block"), "node", F.lit(False).alias("probe"), each("chunks").alias("chunk"))
        .unionByName(
            probes.join(split, "target").select("target", slot("chunks").alias("chunk"), "node", F.lit(True).alias("probe"), each("blocks").alias("block"))
        )
        .join(nodes, "node"),
        "roles",
    )
    if roles.isEmpty():
        return spark.createDataFrame([], "src long, dst long")
    wanted, bits = _with_texts(texts, roles)
    rows = wanted.select("target", "block", "chunk", "probe", "node", "text")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(shuffles, "target", "block", "chunk").sortWithinPartitions("target", "block", "chunk", "probe")
    links = stored(dealt.mapInArrow(_compare(n, percent), "src long, dst long"), "links")
    bits.destroy()
    discard(split, roles)
    return links


def _as_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy().view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(key_bucket(keys).astype(np.int32))], names=["bucket"])


# ---- the join ------------------------------------------------------------------------------------


def candidates(placed: DataFrame, percent: int) -> DataFrame:
    """(node, target): the documents that ask, and the groups they may have a link into, of the index
    entries (token, node, size, need, place, target, count, group_need).

    A document asks a whole group for one number of matches, the least that it or any member needs.
    Linked sets share that many shingles among the first ones that the limits on places leave, so
    every shingle that counts is held to limits of the same number.
    """
    heads = placed.groupBy("token", "target").agg(
        F.first("count").alias("count"), F.first("group_need").alias("need"), F.min("size").alias("least"), F.max("size").alias("most"),
        F.min("place").alias("place"),
    )
    mixed = heads.groupBy("token").agg(F.count(F.lit(1)).alias("_targets")).where("_targets > 1").select("token")
    heads = stored(heads.join(mixed, "token"), "heads")
    asking = placed.join(heads.select("token").distinct(), "token", "left_semi").select(
        "token", F.col("node"), F.col("size"), F.col("need").alias("own_need"), F.col("place").alias("own_place"), F.col("target").alias("own"), F.col("count").alias("own_count")
    )
    smaller = F.struct("own_count", "own") < F.struct("count", "target")
    fits = (100 * F.col("most") >= percent * F.col("size")) & (100 * F.col("size") >= percent * F.col("least"))
    # Sets of sizes x and y must have t / (1 + t) * (x + y) shingles in common, so the matches that
    # count stand among the first x minus that many, and the number asked for, of either order. The
    # bounds hold for every member of a group: its least size, greatest size and first place are used.
    both = lambda other: F.ceil(F.lit(percent / (100 + percent)) * (F.col("size") + F.col(other)) - 1e-9)
    asked_for = F.least("need", "own_need")
    early = (F.col("own_place") < F.col("size") - both("least") + asked_for) & (F.col("place") < F.col("most") - both("most") + asked_for)
    out = stored(
        asking.join(heads, "token")
        .where(smaller & fits & early)
        .groupBy("node", "target")
        .agg(F.count(F.lit(1)).alias("_shared"), F.first(asked_for).alias("_need"))
        .where(F.col("_shared") >= F.col("_need"))
        .select("node", "target"),
        "probes",
    )
    discard(heads)
    return out


def _group_sizes(index: DataFrame, groups: DataFrame) -> DataFrame:
    """Of every node of a group: component, count (the group's nodes) and group_need (their least need).

    Nodes are rows of their own by now, and counted per task before they meet by group.
    """
    own = index.groupBy("node").agg(F.min("need").alias("need")).join(groups, "node")
    sizes = stored(own.groupBy("component").agg(F.count(F.lit(1)).alias("count"), F.min("need").alias("group_need")), "group_sizes")
    few = sizes.count() <= SMALL_GROUPS
    return groups.join(F.broadcast(sizes) if few else sizes, "component")


def _keyed(doc_id: str, text: str) -> list[Column]:
    """What names a row: its id, and a hash of its id and text. Rows without an id, or with a repeated
    one, are told apart by the second."""
    dk = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    return [dk.alias("dk"), F.xxhash64(dk, text).alias("rk")]


def _classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(dk, rk, size, node) of every row, and (node, component, first) of every node: the smallest id of
    its group, and the rk of the group's first row by (dk, rk). See `near_groups`."""
    t = percent / 100
    spark = docs.sparkSession
    texts = docs.select(*_keyed("doc_id", "text"), "text")
    both = stored(texts.mapInArrow(_summaries(n), f"dk long, rk long, size long, node long, {PARTIAL}"), "sets")
    summary = stored(both.where("key is null").select("dk", "rk", "size", "node"), "summary")
    nodes = stored(summary.where("size > 0").groupBy("node").agg(F.min(F.struct("dk", "rk")).alias("_row")).select("node", "_row.dk", "_row.rk"), "nodes")
    sketch = spark.sparkContext.broadcast(frequencies(both.where("key is not null").select("key", "part", "value"), texts.rdd.getNumPartitions()))
    discard(both)
    seen = texts.mapInArrow(_prefixes(n, t, sketch, None), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    shared = spark.sparkContext.broadcast(bitmap(seen.where("n > 1").select("bucket")))
    entries = stored(
        texts.mapInArrow(_prefixes(n, t, sketch, shared), "token long, node long, size int, need int, place int").distinct(), "prefixes"
    )
    sketch.destroy()
    shared.destroy()
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    index = stored(entries.join(lists, "token"), "index")
    discard(entries)

    links = None
    groups = spark.createDataFrame([], "node long, component long")
    long = index.where(F.col("length") > LIST).select("token", "node")
    for step in range(THINNING):
        target = F.coalesce("component", "node").alias("target")
        more = thinned(texts, nodes, long.join(groups, "node", "left").select("token", "node", target), links, n, percent, step)
        if more is None:
            break
        links = more
        groups = stored(components(links), "groups")

    # a node without a group is one of its own
    sizes = stored(_group_sizes(index, groups), "sizes")
    placed = stored(
        index.join(sizes, "node", "left").select(
            "token", "node", "size", "need", "place", F.coalesce("component", "node").alias("target"),
            F.coalesce("count", F.lit(1)).alias("count"), F.coalesce("group_need", "need").alias("group_need"),
        ),
        "placed",
    )
    discard(index, sizes)
    probes = candidates(placed, percent)
    asked = probes.select("target").distinct()
    members = placed.select("node", "target").distinct().join(asked, "target", "left_semi")
    second = verified(texts, nodes, probes, members, n, percent)
    discard(placed, probes)

    whole = components(second if links is None else links.union(second))
    named = nodes.join(whole, "node")
    lowest = named.groupBy("component").agg(F.min(F.struct("dk", "rk")).alias("lowest"))
    classes = stored(
        nodes.join(whole, "node", "left").join(lowest, "component", "left")
        .select("node", F.coalesce("lowest.dk", "dk").alias("component"), F.coalesce("lowest.rk", "rk").alias("first")),
        "classes",
    )
    return summary, classes


def near_groups(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(dk, size, component): each row's id, shingle set size and smallest id reachable by links.

    Two documents link when their sets of `n`-word shingles have a Jaccard similarity of `percent`
    hundredths or more. Words are lower-cased in A-Z; with fewer than `n`, the whole sequence is the
    one shingle. Null, empty and blank texts have no set and link with nothing. Copies of a set are
    one node from the start. A null id comes after all others (as the largest long). No rows give no rows.
    Texts and words may be of any length; other columns are not looked at.

    Long lists of the index, groups of near copies, are first thinned in cells of a bounded size.
    Then every document is compared with all other groups that it shares
    enough prefix shingles with, the smaller group's documents asking; pairs that are already
    connected are left out, all others are verified, so no group is lost however large.
    """
    summary, classes = _classes(docs, n, percent)
    return summary.join(classes, "node", "left").select("dk", "size", F.coalesce("component", "dk").alias("component"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each group: that of the smallest id, and of several with that id, or of
    none with an id, the one whose id and text hash least. Documents without words stay; of rows with
    the same id and text one stays. Columns of any name are carried."""
    carried, names = aside(docs, "doc_id", "text")
    inner = carried.select(*names.values(), *_keyed("doc_id", "text"))
    summary, classes = _classes(docs.select("doc_id", "text"), n, percent)
    gone = summary.join(classes, "node").where((F.col("dk") != F.col("component")) | (F.col("rk") != F.col("first"))).select("dk", "rk").distinct()
    left = inner.join(gone, ["dk", "rk"], "left_anti").dropDuplicates(["dk", "rk"])
    return left.select(*restored_names(names))


@query("op5_ngram_jaccard_join")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return near_groups(docs, 4, 85).select(
        back("dk").alias("doc_id"), F.col("size").alias("n_shingles"), back("component").alias("component_id")
    )
