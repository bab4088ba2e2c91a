"""Append-only outcome logs and tables updated by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.keys import shard_of, task_of
from scoreloom.operators.ordered import join_null_safe
from scoreloom.operators.records import KEY


def latest(log: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """The last row of every key.

    A partial maximum per task, so a key logged over and over shuffles one row per task. A row
    without an order is an error.
    """
    others = [c for c in log.columns if c not in keys]
    known = F.coalesce(F.col(seq), F.raise_error(F.lit(f"a row without {seq}")).cast(log.schema[seq].dataType))
    best = F.max_by(F.struct(*others), known).alias("_row")
    return log.groupBy(*keys).agg(best).select(*keys, "_row.*")


def fold_shards(index: DataFrame, shards: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per key from the index and the shard files written after it.

    An ok row of the index stands against a failing shard row; otherwise the shard row, the later
    attempt, wins. Shard files are folded in the order of their `shard` number.
    """
    columns = [c for c in index.columns if c not in KEY]
    per_shard = latest(shards, [*KEY, "shard"], seq)
    rows = latest(index, KEY, seq).withColumn("_step", F.lit(-1)).unionByName(
        per_shard.withColumnRenamed("shard", "_step")
    )
    # folding keeps an ok row once one is seen, and else the last row; a later ok replaces it
    rank = F.struct((F.col("status") == "ok").cast("int"), F.col("_step"))
    best = F.max_by(F.struct(*columns), rank).alias("_row")
    return rows.groupBy(*KEY).agg(best).select(*KEY, "_row.*")


def upsert(table: DataFrame, news: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`table` with every row of `news` added, or put in place of the row with its keys."""
    both = table.withColumn("_age", F.lit(0)).unionByName(news.withColumn("_age", F.lit(1)))
    return latest(both, keys, "_age").drop("_age")


def work_list(videos: DataFrame, log: DataFrame, redo: Sequence[str] = ()) -> DataFrame:
    """Videos with no outcome yet, or whose last outcome is one to redo."""
    last = latest(log).select(*KEY, F.col("status").alias("_last"))
    joined = join_null_safe(videos, last, KEY, "left")
    todo = F.col("_last").isNull()
    if redo:
        todo = todo | F.col("_last").isin(list(redo))
    return joined.where(todo).drop("_last")


def status_counts(scope: DataFrame, combined: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Videos in scope by task, `by` and last status; no outcome counts as not processed."""
    last = combined.select(*KEY, F.col("status").alias("_last"))
    joined = join_null_safe(scope, last, KEY, "left")
    return joined.groupBy(
        task_of(F.col("key")).alias("task"),
        *by,
        F.coalesce("_last", F.lit("not-processed")).alias("status"),
    ).agg(F.count(F.lit(1)).alias("n"))


def in_order(rows: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Rows in the deterministic order of published tables."""
    return rows.orderBy(*keys, F.coalesce("compression", F.lit("")))


def limited_shard(
    rows: DataFrame, *, limit: int | None = None, shard: tuple[int, int] | None = None
) -> DataFrame:
    """The first `limit` rows in order, then this shard's share of those.

    Limiting first makes the shards of a limited run add up to the unsharded run.
    """
    kept = rows if limit is None else in_order(rows).limit(limit)
    if shard is None:
        return kept
    index, count = shard
    return kept.where(shard_of(F.col("key"), F.col("compression"), count) == index)


def first_per_bucket(
    rows: DataFrame, bucket: Column | str, text: Column, n: int = 20
) -> DataFrame:
    """The `n` smallest texts of every bucket, each with its place.

    Spark cuts each task's rows to `n` per bucket before the shuffle.
    """
    from pyspark.sql import Window

    named = rows.select(
        (F.col(bucket) if isinstance(bucket, str) else bucket).alias("bucket"), text.alias("sample")
    )
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("sample"))
    return named.withColumn("place", place).where(F.col("place") <= n)
