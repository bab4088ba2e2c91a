"""Tables of draws for training and resampling: seeded, order-free and fully distributed.

A draw depends only on (seed, epoch, slot) through a hash, so it is the same however the data is
partitioned and when a task is retried.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError
from scoreloom.functions.keys import hash_pick
from scoreloom.operators.ordered import join_null_safe, numbered


def concat_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Sources one after another, each row with its source's place in the list."""
    tagged = [s.withColumn("source_id", F.lit(i)) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, tagged)


def source_offsets(rows: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Rows, first index and normalised weight per source."""
    if any(w <= 0 for w in weights):
        raise ConfigError(f"every weight must be positive, got {list(weights)}")
    total = sum(weights)
    counts = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    # one row per source: bounded by the number of weights the caller listed
    before = Window.partitionBy(F.lit(0)).orderBy("source_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    weight = F.element_at(
        F.array(*[F.lit(w / total) for w in weights]), F.col("source_id") + 1
    )
    return counts.select(
        "source_id",
        "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_index"),
        weight.alias("weight"),
    )


def _ranked(rows: DataFrame, groups: Sequence[str], order: Sequence[str], blocks: int | None) -> DataFrame:
    return numbered(rows, groups, order, "_rn", blocks=blocks)


def label_balanced_draws(
    rows: DataFrame,
    order: Sequence[str],
    *,
    seed: int,
    epoch: int,
    label: str = "label",
    blocks: int | None = None,
) -> DataFrame:
    """As many draws as rows, with replacement, each label equally likely.

    A hash picks the label of a draw from those present, another the row within it.
    """
    ranked = _ranked(rows, [label], order, blocks)
    # as many rows as there are labels
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).orderBy(label).collect()
    table = F.array(*[F.struct(F.lit(r[0]).alias(label), F.lit(r["_n"]).alias("_n")) for r in sizes])
    spread = _ranked(rows.select(*order, label), [], order, blocks).select(
        (F.col("_rn") - 1).alias("slot")
    )
    text = F.concat_ws(":", F.lit(f"{seed}:{epoch}"), "slot")
    coin = hash_pick(F.concat(text, F.lit(":label")), F.lit(len(sizes)))
    drawn = spread.withColumn("_l", F.get(table, coin.cast("int")))
    pick = hash_pick(F.concat(text, F.lit(":row")), F.col("_l._n")) + 1
    picks = drawn.select("slot", F.col(f"_l.{label}").alias(label), pick.alias("_rn"))
    return picks.join(ranked, [label, "_rn"]).drop("_rn")


def source_weighted_draws(
    rows: DataFrame,
    order: Sequence[str],
    weights: Sequence[float],
    *,
    seed: int,
    epoch: int,
    blocks: int | None = None,
) -> DataFrame:
    """As many draws as rows, with replacement; sources are picked by weight, rows evenly.

    `rows` carries `source_id`; `weights` lists one positive number per source.
    """
    total = float(sum(weights))
    ranked = _ranked(rows, ["source_id"], order, blocks)
    # one row per listed source
    sizes = dict(rows.groupBy("source_id").agg(F.count(F.lit(1))).collect())
    count = F.element_at(
        F.array(*[F.lit(sizes.get(i, 0)) for i in range(len(weights))]), F.col("source_id") + 1
    )
    slots = _ranked(rows.select("source_id", *order), [], ["source_id", *order], blocks).select(
        (F.col("_rn") - 1).alias("slot")
    )
    text = F.concat_ws(":", F.lit(f"{seed}:{epoch}"), "slot")
    u = hash_pick(F.concat(text, F.lit(":source")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    source: Column = F.lit(len(weights) - 1)
    reached = total
    for i in range(len(weights) - 1, 0, -1):
        reached -= weights[i]
        source = F.when(u < F.lit(reached / total), F.lit(i - 1)).otherwise(source)
    drawn = slots.select("slot", source.alias("source_id"), text.alias("_t"))
    pick = hash_pick(F.concat("_t", F.lit(":row")), count) + 1
    picks = drawn.select("slot", "source_id", pick.alias("_rn"))
    return picks.join(ranked, ["source_id", "_rn"]).drop("_rn")


def epoch_shuffle(
    rows: DataFrame, order: Sequence[str], *, seed: int, epoch: int, blocks: int | None = None
) -> DataFrame:
    """Every row once, numbered from 0 in an order that depends on (seed, epoch) alone."""
    shuffled = rows.withColumn(
        "_h", F.sha2(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), *order), 256)
    )
    out = numbered(shuffled, [], ["_h", *order], "place", blocks=blocks)
    return out.withColumn("place", F.col("place") - 1).drop("_h")


def equal_batches(group_index: Column, group_size: int, batch_size: int) -> Column:
    """The batch of a group when all groups have one size: whole groups, batches in order."""
    if batch_size < 1:
        raise ConfigError(f"batch_size must be positive, got {batch_size}")
    return F.floor(group_index / F.lit(max(1, batch_size // max(1, group_size))))


# Groups one task packs at a time.
_PACK_BLOCK = 100_000


def packed_batches(
    groups: DataFrame,
    batch_size: int,
    *,
    by: Sequence[str] = (),
    index: str = "group_index",
    size: str = "size",
    block_rows: int = _PACK_BLOCK,
) -> DataFrame:
    """The batch of every group when sizes differ: a group that does not fit closes the batch.

    The fold carries one number, how full the open batch is, so a block of groups is a map from the
    fill before it to (batches closed, fill after). Blocks work out that map for every possible
    fill side by side; the maps are chained, one row per block; then each block packs with its own
    true start. No block needs the one before it to be in the same task.
    """
    if batch_size < 1:
        raise ConfigError(f"batch_size must be positive, got {batch_size}")
    by = list(by)
    kinds = dict(groups.dtypes)
    columns = groups.columns
    cut = groups.withColumn("_b", F.floor(F.col(index) / block_rows))
    key = [*by, "_b"]
    fields = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "_b long"])

    def summarise(part: pd.DataFrame) -> pd.DataFrame:
        """For every fill 0..batch_size + 1 (the last stands for any overfull batch), the exit state."""
        sizes = part.sort_values(index)[size].to_numpy()
        fill = np.arange(batch_size + 2)
        closed = np.zeros(batch_size + 2, dtype=np.int64)
        for n in sizes:
            over = (fill > 0) & (fill + n > batch_size)
            closed += over
            fill = np.minimum(np.where(over, n, fill + n), batch_size + 1)
        out = part.iloc[:1][key].copy()
        out["fills"], out["closed"] = [fill.tolist()], [closed.tolist()]
        return out

    maps = cut.groupBy(*key).applyInPandas(summarise, f"{fields}, fills array<long>, closed array<long>")

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        """Every block's true start, from one row per block of 100,000 groups."""
        part = part.sort_values("_b")
        fill = batch = 0
        starts = []
        for fills, closed in zip(part["fills"], part["closed"], strict=True):
            starts.append((fill, batch))
            fill, batch = int(fills[fill]), batch + int(closed[fill])
        out = part[key].copy()
        out[["_fill", "_batch"]] = starts
        return out

    starts = maps.groupBy(*by).applyInPandas(chain, f"{fields}, _fill long, _batch long")
    seeded = join_null_safe(cut, starts, key)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(index)
        fill, batch = int(part["_fill"].iloc[0]), int(part["_batch"].iloc[0])
        out = np.empty(len(part), dtype=np.int64)
        for i, n in enumerate(part[size].to_numpy()):
            if fill > 0 and fill + n > batch_size:
                batch, fill = batch + 1, 0
            fill += n
            out[i] = batch
        return part[columns].assign(batch=out)

    shown = ", ".join(f"`{c}` {t}" for c, t in groups.dtypes)
    return seeded.groupBy(*key).applyInPandas(pack, f"{shown}, batch long")


def train_clips(
    rows: DataFrame,
    *,
    stored: str,
    sample: str,
    clip: str,
    frames: int,
    clips: int,
    seed: int,
    epoch: int,
    sampling: str = "uniform",
    stride: int = 1,
) -> DataFrame:
    """Seeded training clips: rows with `positions` and `padded` of their one clip.

    Each sample has its own generator seeded by (seed, epoch, sample), so a draw is the same in any
    partition. All of a sample's windows are drawn before the one asked for is kept.
    """
    if sampling not in ("uniform", "consecutive", "random-window"):
        raise ConfigError(f"unknown clip sampling {sampling!r}")

    def draw(n: int, i: int, which: int) -> tuple[list[int], bool]:
        rng = random.Random(f"{seed}:{epoch}:{i}")
        if sampling == "uniform":
            total = clips * frames
            edges = [k * n // total for k in range(total + 1)]
            spots = [rng.randint(lo, max(hi - 1, lo)) for lo, hi in zip(edges, edges[1:])]
            return spots[which * frames : (which + 1) * frames], False
        last = max(n - frames * stride, 0)
        start = [rng.randint(0, last) for _ in range(clips)][which]
        run = range(start, start + frames * stride, stride)
        return [min(p, n - 1) for p in run], run[-1] >= n

    @F.pandas_udf("positions array<int>, padded boolean")
    def windows(n: pd.Series, i: pd.Series, which: pd.Series) -> pd.DataFrame:
        drawn = [draw(int(a), int(b), int(c)) for a, b, c in zip(n, i, which)]
        return pd.DataFrame(drawn, columns=["positions", "padded"])

    w = windows(F.col(stored), F.col(sample), F.col(clip))
    return rows.withColumn("_w", w).select(*rows.columns, "_w.positions", "_w.padded")
