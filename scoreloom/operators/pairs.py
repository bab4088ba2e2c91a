"""Pairing fakes with their reals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError
from scoreloom.functions.keys import local_key, task_of
from scoreloom.operators.ordered import numbered


def resolve_pairs(
    videos: DataFrame,
    *,
    is_real: Column,
    candidates: Column,
    fanout_cap: int | None,
    rule: str,
    task_rank: Mapping[str, int] | None = None,
) -> DataFrame:
    """(fake_key, real_key, rule), one row per pair.

    A candidate value that is some real's local key pairs with those reals. Any other value is
    tried as an identity, and pairs with that identity's first `fanout_cap` reals in order. Reals
    are cut to the cap before they meet the fakes, so an identity with very many reals adds
    nothing beyond the pairs asked for.
    """
    if fanout_cap is not None and fanout_cap < 0:
        raise ConfigError(f"fanout_cap must be at least 0, got {fanout_cap}")
    real_rows = videos.where(is_real).select(
        "key", local_key(F.col("key")).alias("_value"), F.nullif("identity", F.lit("")).alias("_id")
    )
    reals = real_rows.select(F.col("key").alias("real_key"), "_value").distinct()
    wanted = (
        videos.where(~is_real)
        .select(F.col("key").alias("fake_key"), F.explode(candidates).alias("_value"))
        .where(F.col("_value") != "")
        .distinct()
    )
    by_local = wanted.join(reals, "_value").select("fake_key", "real_key")

    rest = wanted.join(reals.select("_value").distinct(), "_value", "left_anti")
    owned = real_rows.where(F.col("_id").isNotNull()).select(
        F.col("_id").alias("_value"), F.col("key").alias("real_key")
    ).distinct()
    if fanout_cap is not None:
        owned = _first_reals(owned, fanout_cap, task_rank)
    by_identity = rest.join(owned, "_value").select("fake_key", "real_key")
    return by_local.unionByName(by_identity).distinct().withColumn("rule", F.lit(rule))


def _first_reals(
    owned: DataFrame, cap: int, task_rank: Mapping[str, int] | None
) -> DataFrame:
    """The first `cap` reals of each identity by (local key, task rank, task).

    A row-number filter this small is applied inside each task before the shuffle as well, so an
    identity holding a third of all reals sends `cap` rows per task.
    """
    key = F.col("real_key")
    task = task_of(key)
    rank = F.lit(0)
    if task_rank is not None:
        rank = F.coalesce(*[F.when(task == t, F.lit(i)) for t, i in task_rank.items()])
    first = Window.partitionBy("_value").orderBy(local_key(key), rank, task)
    return owned.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= cap).drop("_n")


def pairs_of_split(pairs: DataFrame, splits: DataFrame, split: str) -> DataFrame:
    """Pairs whose real is in the split, or whose fake is when the real has no split.

    A key with several compressions takes the split of its last row in key order.
    """
    last = splits.groupBy("key").agg(
        F.max_by("split", F.coalesce("compression", F.lit(""))).alias("s")
    )
    real = last.select(F.col("key").alias("real_key"), F.col("s").alias("_real_split"))
    fake = last.select(F.col("key").alias("fake_key"), F.col("s").alias("_fake_split"))
    return (
        pairs.join(real, "real_key", "left")
        .join(fake, "fake_key", "left")
        .where(F.coalesce("_real_split", "_fake_split") == split)
        .select(*pairs.columns)
    )


def _first_compression(index: DataFrame) -> DataFrame:
    others = [c for c in index.columns if c != "key"]
    first = F.min_by(F.struct(*others), F.coalesce("compression", F.lit(""))).alias("_item")
    return index.groupBy("key").agg(first)


def paired_items(
    index: DataFrame, pairs: DataFrame, *, blocks: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Pairs whose both ends are indexed, numbered from 0 in (real, fake) order; and the dropped."""
    items = _first_compression(index)
    real = items.select(F.col("key").alias("real_key"), F.col("_item").alias("real_item"))
    fake = items.select(F.col("key").alias("fake_key"), F.col("_item").alias("fake_item"))
    joined = pairs.join(real, "real_key", "left").join(fake, "fake_key", "left")
    whole = F.col("real_item").isNotNull() & F.col("fake_item").isNotNull()
    kept = numbered(joined.where(whole), [], ["real_key", "fake_key"], "pair_id", blocks=blocks)
    return kept.withColumn("pair_id", F.col("pair_id") - 1), joined.where(~whole).select(
        *pairs.columns
    )
