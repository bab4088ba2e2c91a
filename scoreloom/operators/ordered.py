"""Ordered operators that never put a whole group into one task.

A running sum over a group is taken in two levels. Rows carry a block number that grows with the
order; each (group, block) is summed on its own, and the totals of the blocks before it are added.
Only the block totals, a bounded number per group, are ever ordered together.

Blocks come from one of two places. Histograms ordered by a number are cut at that number's quantiles
in their group, read from a mergeable sketch per group; the plan stays lazy, and cells that crowd
together are many blocks all the same. Any other order is cut by Spark's range partitioning; the
ranges are written once, with their numbers, so that all that reads them sees the same blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.session import materialized

# Blocks of a group that is cut at quantiles, a power of two, and the ranks its sketch tells apart.
QUANTILE_BLOCKS = 256
SKETCH_RANKS = 4096


def with_quantile_block(
    df: DataFrame, groups: Sequence[str], value: str, sums: Sequence[Column] = ()
) -> DataFrame:
    """`df` with `_block`, which never falls as `value` grows and holds even shares of a group's rows.

    The cuts are values of the group, so equal values share a block. They are found by halving steps.
    Rows whose `sums` are null add nothing and have no say in the cuts; that the cuts read these columns
    lets them share the exchange of the sums.
    """
    probs = [i / QUANTILE_BLOCKS for i in range(1, QUANTILE_BLOCKS)]
    counted = reduce(lambda a, b: a & b, [x.isNotNull() for x in sums], F.lit(True))
    cut_values = F.percentile_approx(F.when(counted, F.col(value)), probs, SKETCH_RANKS)
    cuts = df.groupBy(*groups).agg(cut_values.alias("_cuts"))
    steps = [QUANTILE_BLOCKS >> i for i in range(1, QUANTILE_BLOCKS.bit_length())]

    def further(at: Column, step: Column) -> Column:
        return F.when(F.get(F.col("_cuts"), at + step - 1) <= F.col(value), at + step).otherwise(at)

    # without groups there is one row of cuts
    joined = join_null_safe(df, cuts, groups) if groups else df.join(F.broadcast(cuts))
    block = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)
    return joined.withColumn("_block", block).drop("_cuts")


def with_range_block(df: DataFrame, order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """`df` with `_block`, which never falls along `order`, written in ranges of about equal size.

    Spark samples every task for the range bounds, and makes as many ranges as it has shuffle
    partitions, or `blocks`.
    """
    ranged = df.repartitionByRange(blocks, *order) if blocks else df.repartitionByRange(*order)
    return materialized(ranged.withColumn("_block", F.spark_partition_id()), "ranges")


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on `keys` where null matches null, keeping one copy of the keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    out = left.join(renamed, on, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how in ("full_outer", "outer", "full"):
        # every key is null on the absent side; a null key that is present on both sides is null
        # on both, so coalesce is exact
        merged = [F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) for k in keys]
        rest = [c for c in left.columns if c not in keys] + [
            c for c in right.columns if c not in keys
        ]
        return out.select(*merged, *rest)
    return out.drop(*[f"_r_{k}" for k in keys])


def prefix_sums(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column],
    *,
    descending: bool = False,
    totals: Mapping[str, str] | None = None,
    ranges: bool = False,
    blocks: int | None = None,
) -> DataFrame:
    """`df` with a running sum per entry of `sums`, inclusive of the row, ordered by `order`.

    Blocks are quantiles of the first column of `order`, a number; with `ranges` those of the whole
    order, whatever its columns, `blocks` of them if given. `totals` optionally names columns that
    receive each sum over the whole group.
    """
    groups = list(groups)
    if ranges:
        blocked = with_range_block(df, [*groups, *order], blocks)
    else:
        blocked = with_quantile_block(df, groups, order[0], list(sums.values()))
    by = [*groups, "_block"]
    direction = F.desc if descending else F.asc
    within = (
        Window.partitionBy(*by)
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = blocked
    for name, value in sums.items():
        running = running.withColumn(f"_run_{name}", F.sum(value).over(within))
    per_block = blocked.groupBy(*by).agg(
        *[F.sum(value).alias(f"_blk_{name}") for name, value in sums.items()]
    )
    group_key = groups or [F.lit(0)]
    before = (
        Window.partitionBy(*group_key)
        .orderBy(direction("_block"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(*group_key)
    offsets = per_block.select(
        *by,
        *[
            F.coalesce(F.sum(f"_blk_{name}").over(before), F.lit(0)).alias(f"_off_{name}")
            for name in sums
        ],
        *[F.sum(f"_blk_{name}").over(whole).alias(col) for name, col in (totals or {}).items()],
    )
    joined = join_null_safe(running, offsets, by, "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"_run_{name}") + F.col(f"_off_{name}")).alias(name) for name in sums],
        *(totals or {}).values(),
    )


def numbered(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    name: str = "rn",
    *,
    blocks: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """A 1-based row number per group in `order`, whatever the size of a group.

    `total` names a column for the group's number of rows.
    """
    totals = {name: total} if total else None
    return prefix_sums(df, groups, order, {name: F.lit(1)}, totals=totals, ranges=True, blocks=blocks)


def carried_forward(df: DataFrame, order: Sequence[str], value: Column, name: str, blocks: int | None = None) -> DataFrame:
    """`df` with the greatest `value` up to each row of `order`, null values aside: where values rise
    along the order, the latest one known at the row."""
    blocked = with_range_block(df, order, blocks)
    within = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = blocked.withColumn("_own", F.max(value).over(within))
    # one row per range
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy("_block").agg(F.max(value).alias("_last"))
    earlier = totals.select("_block", F.max("_last").over(before).alias("_earlier"))
    return running.join(earlier, "_block").select(*df.columns, F.coalesce("_own", "_earlier").alias(name))


# Leading hexadecimal digits by which hashes are counted: 65,536 counts per group at most.
HASH_DIGITS = 4


def smallest_hashes(rows: DataFrame, groups: Sequence[str], hashed: str, k: int) -> DataFrame:
    """The `k` rows of every group with the smallest values of `hashed`, hexadecimal and of one length.

    Rows are counted per group and leading digits, which merges over tasks. The digits at which a
    group's count passes `k` part it: rows before are in, rows after are out, and only those at these
    digits are ordered. A group of `k` rows or fewer is kept whole. Null groups are groups.
    """
    if k <= 0:
        return rows.limit(0)
    groups = list(groups)
    keyed = rows.withColumn("_lead", F.substring(hashed, 1, HASH_DIGITS))
    counts = keyed.groupBy(*groups, "_lead").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*(groups or [F.lit(0)]))
    before = F.coalesce(F.sum("_n").over(by.orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    passed = counts.withColumn("_before", before).where((F.col("_before") < k) & (F.col("_before") + F.col("_n") >= k))
    cuts = passed.select(*groups, F.col("_lead").alias("_cut"), (F.lit(k) - F.col("_before")).alias("_more"))
    joined = join_null_safe(keyed, cuts, groups, "left") if groups else keyed.join(F.broadcast(cuts), how="left")
    inside = joined.where(F.col("_cut").isNull() | (F.col("_lead") < F.col("_cut")))
    place = F.row_number().over(Window.partitionBy(*groups, "_lead").orderBy(hashed))
    at = joined.where(F.col("_lead") == F.col("_cut")).withColumn("_place", place).where(F.col("_place") <= F.col("_more"))
    return inside.select(*rows.columns).unionByName(at.select(*rows.columns))


def weighted_quantiles(
    hist: DataFrame, groups: Sequence[str], value: str, weight: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per group of a (value, weight) histogram of unit scores.

    One column per entry of `probs`. A quantile at position q*(n-1) lies between two order
    statistics; both are picked by their running count, so no group is gathered.
    """
    run = prefix_sums(
        hist, groups, [value], {"_cum": F.col(weight)}, totals={"_cum": "_n"}
    )
    aggs = []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        first = F.col("_cum") - F.col(weight)  # 0-based rank of the value's first copy
        low, high = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((first <= low) & (low < F.col("_cum")), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((first <= high) & (high < F.col("_cum")), F.col(value))).alias(f"_hi_{name}"),
        ]
    picked = run.groupBy(*groups).agg(F.max("_n").alias("_n"), *aggs)
    out = []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return picked.select(*groups, *out)


def midranks(df: DataFrame, groups: Sequence[str], value: str, name: str = "midrank") -> DataFrame:
    """Each distinct value of a unit-score column with its 1-based mean rank over ties and count."""
    counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    run = prefix_sums(counts, groups, [value], {"_cum": F.col("n")})
    return run.select(
        *groups, value, "n", (F.col("_cum") - (F.col("n") - 1) / F.lit(2.0)).alias(name)
    )
