"""What the operators share: tables, words, stored intermediates and small column helpers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.session import shared_folder

# Words are maximal runs of characters other than ASCII white space. bytes.split() cuts at exactly
# these six bytes, and bytes.lower() folds exactly A-Z.
WORD = r"[^\x20\x09-\x0D]+"

#: Whether a query's shuffle files go when it ends, not when the driver collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends there, lost executors or not.
    Nothing reads the shuffles of a finished write again, so they are dropped with it."""
    path = shared_folder(df.sparkSession, name)
    before = df.sparkSession.conf.get(DROP_SHUFFLES, "false")
    df.sparkSession.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(DROP_SHUFFLES, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of `stored` tables that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: the optimizer may copy a column, never a lambda's
    variable."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Words of a text; none in a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text, the key of held-out folds. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def hex_unit(hex_digits: Column) -> Column:
    """A number in [0, 1) of the first 13 hexadecimal digits: exact in a double."""
    return F.conv(F.substring(hex_digits, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with every column under a name of its own, and the needed ones once more under theirs;
    and these names. No column of the input can clash with one that an operator makes."""
    names = {c: f"_carried_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(m) for c, m in names.items()], *needed), names


def restored_names(names: dict[str, str], added: Sequence[str] = (), without: Sequence[str] = ()) -> list[Column]:
    """The carried columns under their old names, then the added ones, which replace any of their name."""
    return [*[F.col(m).alias(c) for c, m in names.items() if c not in added and c not in without], *map(F.col, added)]


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_FOLD = np.arange(256)
_FOLD[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of many texts as one flat array of hashes: no word becomes a Python object.

    A word's hash is a polynomial of its bytes, looked up as random 64-bit numbers, and its length.
    `doc` is the text of each word, `start` and `end` its bytes in `flat`; `fold` lower-cases A-Z.
    """

    def __init__(self, texts: Sequence[str | None], fold: bool = False):
        raw = [(t or "").encode() for t in texts]
        self.flat = b"\n".join([*raw, b""])
        data = np.frombuffer(self.flat, np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[::2], edge[1::2]
        length = self.end - self.start
        closes = np.cumsum([len(r) + 1 for r in raw])
        self.doc = np.searchsorted(closes, self.start, "right")
        self.counts = np.bincount(self.doc, minlength=len(raw))
        if len(length) == 0:
            self.hashes = np.zeros(0, np.uint64)
            return
        table = mix64(np.arange(1, 257).astype(np.uint64))
        table = table[_FOLD] if fold else table
        first = np.cumsum(length) - length
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64))
            offset = np.arange(int(length.sum())) - np.repeat(first, length)
            value = table[data[~space]] * power[offset]
            self.hashes = mix64(np.add.reduceat(value, first) + length.astype(np.uint64))

    def shingles(self, n: int) -> list[np.ndarray]:
        """The hashes of the runs of `n` words of every text, sorted, each once; of a shorter text as a whole."""
        w, counts = self.hashes, self.counts
        many = shingle_hashes(w, n) if len(w) >= n else w[:0]
        first = np.cumsum(counts) - counts
        out = []
        for a, c in zip(first.tolist(), counts.tolist()):
            s = np.sort(many[a : a + c - n + 1] if c >= n else shingle_hashes(w[a : a + c], n))
            out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) else s)
        return out


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about `most` bytes in `column`, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.zeros(batch.num_rows, np.int64)
        lengths = pc.fill_null(pc.binary_length(col), 0)
        sizes[:] = lengths.to_numpy(zero_copy_only=False)
        run = (np.cumsum(sizes) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of `n` hashed words; of the whole sequence when it has fewer."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(h)])
    return h


# ---- bitmaps of hashed keys ----------------------------------------------------------------------

BLOCK_BITS = 15
KEY_BITS = 28


def key_bucket(keys: np.ndarray) -> np.ndarray:
    """The bit of each 64-bit key in a bitmap of fixed size."""
    return (mix64(keys.astype(np.uint64)) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def has_bit(bits: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    bucket = bucket >> (KEY_BITS - (len(bits).bit_length() + 2))
    return ((bits[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1) == 1


def bitmap(buckets: DataFrame) -> np.ndarray:
    """The bitmap of a table (bucket): 2**KEY_BITS bits, 32 MB, at most, however many rows there are.
    One of few bits is folded to a smaller size: neighbouring bits become one.

    Set bits become packed blocks on the executors, and are folded there; the driver only puts the
    blocks together.
    """
    size = 1 << BLOCK_BITS

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, ones = [], []
            for offsets in pdf["offsets"]:
                on = np.zeros(size, np.uint8)
                on[np.asarray(offsets, np.int64)] = 1
                out.append(np.packbits(on, bitorder="little").tobytes())
                ones.append(int(on.sum()))
            yield pd.DataFrame({"block": pdf["block"], "bits": out, "ones": ones})

    blocks = stored(
        buckets.groupBy(F.floor(F.col("bucket") / size).cast("int").alias("block"))
        .agg(F.collect_set((F.col("bucket") % size).cast("int")).alias("offsets"))
        .mapInPandas(pack, "block int, bits binary, ones long"),
        "bits",
    )
    ones = blocks.agg(F.sum("ones")).first()[0] or 0
    folds = 0
    while folds < BLOCK_BITS - 4 and (ones << (folds + 1)) < 1 << (KEY_BITS - 6):
        folds += 1

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = [np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little").reshape(-1, 1 << folds).max(axis=1) for b in pdf["bits"]]
            yield pd.DataFrame({"block": pdf["block"], "bits": [np.packbits(b, bitorder="little").tobytes() for b in bits]})

    width = size >> folds >> 3
    bits = np.zeros(1 << (KEY_BITS - 3 - folds), np.uint8)
    for row in blocks.mapInPandas(fold, "block int, bits binary").toLocalIterator():
        bits[row["block"] * width : (row["block"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    discard(blocks)
    return bits


# ---- sums of arrays over all tasks ---------------------------------------------------------------

PARTIAL = "key int, part int, value binary"


def partial(key: int, part: int, value: np.ndarray) -> pa.RecordBatch:
    """A task's share of the array named `key`, packed."""
    return pa.RecordBatch.from_arrays(
        [pa.array([key], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(value.tobytes(), 1)], pa.binary())],
        names=["key", "part", "value"],
    )


def summed(
    parts: DataFrame, dtype: type, tasks: int, finish: Callable[[np.ndarray], np.ndarray] = lambda total: total
) -> dict[int, np.ndarray]:
    """The sums of PARTIAL arrays by key, each after `finish`. They are added 64 at a time, so that no
    task meets those of all others; what reaches the driver is one finished array per key."""

    def adding(finish: Callable[[np.ndarray], np.ndarray]):
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = finish(sum(np.frombuffer(zlib.decompress(v), dtype) for v in pdf.sort_values("part")["value"]))
            return pd.DataFrame({"key": pdf["key"].iloc[:1], "part": pdf["part"].iloc[:1] // 64, "value": [zlib.compress(total.tobytes(), 1)]})

        return add

    while True:
        tasks = -(-tasks // 64)
        step = adding(finish if tasks <= 1 else lambda total: total)
        parts = parts.groupBy("key", F.floor(F.col("part") / 64)).applyInPandas(step, PARTIAL)
        if tasks <= 1:
            kind = finish(np.zeros(1, dtype)).dtype
            return {row["key"]: np.frombuffer(zlib.decompress(row["value"]), kind) for row in parts.toLocalIterator()}
