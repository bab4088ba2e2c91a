"""Embedding near-dedup: PCA-ordered comparison of tiles, with early stopping by suffix norms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import PARTIAL, partial, query, stored, summed, table
from scoreloom.llm.components import components

#: Dimensions that are compared at once before the bound is looked at again.
STEP = 16
#: Rows of a block: at least and at most. There are 16 blocks until they would be larger than that.
SMALL, LARGE = 512, 65_536
#: Rows of the left block that are multiplied with the right one at a time.
BAND = 512
#: Bounds are computed in single precision; what they let through is decided in double precision.
SLACK = 1e-4


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dim, node, vec): the unit vectors as packed doubles, null where a vector can't be compared."""
    for batch in batches:
        dims, nodes, packed = [], [], []
        for value in batch.column("embedding"):
            v = None
            if value.is_valid and value.values.null_count == 0 and len(value.values):
                v = value.values.to_numpy().astype(np.float64)
                largest = np.abs(v).max() if np.isfinite(v).all() else 0.0
                v = v / largest if largest > 0 else None  # so that squares neither vanish nor overflow
            if v is None:
                dims.append(None), nodes.append(None), packed.append(None)
            else:
                raw = (v / np.sqrt(v @ v)).tobytes()
                dims.append(len(v)), packed.append(raw)
                h = xxhash.xxh3_64_intdigest(raw)
                nodes.append(h - (1 << 64) if h >> 63 else h)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())],
            names=["vec_id", "dim", "node", "vec"],
        )


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension the rotation onto the axes of greatest second moment first, over all rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                x = np.stack([np.frombuffer(v.as_buffer(), np.float64) for v, n in zip(batch.column("vec"), dims) if n == d])
                sums[int(d)] = sums.get(int(d), 0) + x.T @ x
        for d, m in sums.items():
            yield partial(d, TaskContext.get().partitionId(), m)

    found = summed(rows.select("dim", "vec").mapInArrow(moments, PARTIAL), np.float64, rows.rdd.getNumPartitions())
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1] for d, m in found.items()}


def _pairs(x: np.ndarray, y: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with a cosine of `least` or more; each once if both sides are the same.

    The leading dimensions are multiplied for all pairs. What the others can add is at most the
    product of their norms: a pair that can't reach `least` stops there. The rest go on in steps.
    """
    d = x.shape[1]
    cuts = list(range(STEP, d, STEP)) or [d]
    tail = lambda v: {c: np.sqrt(np.maximum((v[:, c:] ** 2).sum(1), 0)) for c in cuts}
    tx, ty = tail(x), tail(y)
    c = cuts[0]
    lead_y, left_y = y[:, :c].T.astype(np.float32), ty[c].astype(np.float32)
    rows, cols = [], []
    for a in range(0, len(x), BAND):
        score = x[a : a + BAND, :c].astype(np.float32) @ lead_y
        reach = score + tx[c][a : a + BAND, None].astype(np.float32) * left_y
        i, j = np.nonzero(reach >= least - SLACK)
        i += a
        if same:
            i, j = i[i < j], j[i < j]
        rows.append(i)
        cols.append(j)
    i, j = np.concatenate(rows), np.concatenate(cols)
    kept_i, kept_j = [i[:0]], [j[:0]]
    for a in range(0, len(i), 1 << 17):
        p, q = i[a : a + (1 << 17)], j[a : a + (1 << 17)]
        total, before = np.zeros(len(p)), 0
        for c in cuts:
            total += np.einsum("ij,ij->i", x[p, before:c], y[q, before:c])
            go = total + tx[c][p] * ty[c][q] >= least - SLACK
            p, q, total, before = p[go], q[go], total[go], c
        total += np.einsum("ij,ij->i", x[p, before:], y[q, before:])
        kept_i.append(p[total >= least])
        kept_j.append(q[total >= least])
    return np.concatenate(kept_i), np.concatenate(kept_j)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each index over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tile(axes, least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
        turn = axes.value[int(pdf["dim"].iloc[0])]
        pdf = pdf.sort_values("node")
        sides = [pdf[pdf["block"] == b] for b in ((low,) if low == high else (low, high))]
        if any(len(s) == 0 for s in sides):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        vectors = [np.stack([np.frombuffer(v, np.float64) for v in s["vec"]]) @ turn for s in sides]
        i, j = _pairs(vectors[0], vectors[-1], least, low == high)
        j = j if low == high else j + len(sides[0])
        both = pd.concat(sides)
        copies = both["copies"].to_numpy()
        links = np.bincount(i, copies[j], len(both)) + np.bincount(j, copies[i], len(both))
        root = _roots(len(both), i, j)
        node = both["node"].to_numpy()
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "root": node[root[some]]})

    return run


def near_vectors(rows: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id): how many other vectors each links with, and its group.

    Vectors link when their cosine, in double precision, is `least` or more. Equal unit vectors are
    one node with a number of copies; copies link with each other. Nodes are dealt into blocks by
    hash and every pair of blocks is one tile. A tile returns sums per vector and one edge to the
    root of its group, never its pairs. Null, empty and zero vectors, and vectors with null or
    non-finite components, link with nothing; vectors of different dimensions don't link. Rows that
    share a vec_id are different vectors in one group. No rows give no rows.
    """
    spark = rows.sparkSession
    units = stored(
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_units, "vec_id long, dim int, node long, vec binary"),
        "units",
    )
    valid = units.where("node is not null")
    nodes = stored(
        valid.groupBy("node", "dim").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("lowest"), F.first("vec").alias("vec")), "vectors"
    )
    axes = spark.sparkContext.broadcast(principal_axes(valid))
    n = nodes.count()
    size = min(max(SMALL, n // 16), LARGE)
    blocks = max(1, -(-n // size))
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    dealt = nodes.withColumn("block", block).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    tiles = dealt.select(
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "dim", "block", "node", "copies", "vec"
    )
    found = stored(tiles.groupBy("low", "high", "dim").applyInPandas(_tile(axes, least), "node long, links long, root long"), "tiles")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    placed = nodes.select("node", "copies", "lowest").join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = placed.groupBy("component").agg(F.min("lowest").alias("component_id"))
    classes = stored(
        placed.join(lowest, "component").join(links, "node", "left").select(
            "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
        ),
        "classes",
    )
    return units.select("vec_id", "node").join(classes, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )


@query(
    "op9_embedding_near_dedup",
    """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND list_sum(list_transform(embedding, lambda e: e * e)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b
  WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id, vec_id AS low FROM embeddings UNION SELECT p.a, r.low FROM r JOIN p ON r.vec_id = p.b)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE a = e.vec_id) AS n_links, (SELECT min(low) FROM r WHERE r.vec_id = e.vec_id) AS component_id,
  e.vec_id = (SELECT min(low) FROM r WHERE r.vec_id = e.vec_id) AS kept
FROM embeddings e
""",
)
def op9(spark, sf_dir):
    found = near_vectors(table(spark, sf_dir, "embeddings"), 0.9)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))
