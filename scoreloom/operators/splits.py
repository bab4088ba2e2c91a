"""Split rules: each takes videos and gives (key, compression, split) for those it assigns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError, ContractError
from scoreloom.functions.keys import (
    TEST_72_14_14,
    VAL_72_14_14,
    VAL_80_20,
    carve_key,
    local_key,
    md5_mod,
    task_of,
)
from scoreloom.operators.ordered import join_null_safe, numbered, smallest_hashes
from scoreloom.operators.records import KEY, SPLITS

# The policies' names.
POLICIES = ("test-only-official", "official-train-test")


def _assigned(rows: DataFrame, split: Column) -> DataFrame:
    return rows.select(*KEY, split.alias("split"))


def _hundredth() -> Column:
    return md5_mod(carve_key(F.col("key"), F.col("identity")), 100)


def _carve_80_20() -> Column:
    return F.when(_hundredth() < VAL_80_20, "val").otherwise("train")


def all_test(videos: DataFrame) -> DataFrame:
    return _assigned(videos, F.lit("test"))


def carve_72_14_14(videos: DataFrame) -> DataFrame:
    """Identity-disjoint train/val/test by hash."""
    h = _hundredth()
    split = F.when(h < VAL_72_14_14, "val").when(h < TEST_72_14_14, "test").otherwise("train")
    return _assigned(videos, split)


def carve_80_20(videos: DataFrame) -> DataFrame:
    """Identity-disjoint train/val by hash."""
    return _assigned(videos, _carve_80_20())


def bad_official_rows(official: DataFrame) -> DataFrame:
    return official.where(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)))


def official(videos: DataFrame, listed: DataFrame) -> DataFrame:
    """The publisher's split, given per key and applied to every compression of it."""
    return videos.select(*KEY).join(listed.select("key", "split"), "key").select(*KEY, "split")


def official_plus_80_20(videos: DataFrame, listed: DataFrame, policy: str) -> DataFrame:
    """The publisher's test split with train and val carved from the rest.

    `test-only-official` carves every other video; `official-train-test` only the listed train.
    A listed exclude stays excluded. `listed` must hold no val row: `official_val_rows` finds them.
    """
    if policy not in POLICIES:
        raise ConfigError(f"unknown policy {policy!r}; known: {', '.join(POLICIES)}")
    given = listed.select("key", F.col("split").alias("_listed"))
    rows = videos.select(*KEY, "identity").join(given, "key", "left")
    keep = F.col("_listed").isin("test", "exclude")
    carved = F.lit(True) if policy == "test-only-official" else F.col("_listed") == "train"
    split = F.when(keep, F.col("_listed")).when(carved, _carve_80_20())
    return _assigned(rows, split).where(F.col("split").isNotNull())


def official_val_rows(listed: DataFrame) -> DataFrame:
    return listed.where(F.col("split") == "val")


# What a benchmark may be stratified by.
STRATA = ("identity", "target_id", "source_id", "task")


DRAWS = ("hashed", "sequence")


@dataclass(frozen=True)
class BenchmarkSpec:
    """A seeded test subset: `k_fake` fakes (per stratum if any), then up to as many reals.

    A hashed draw takes the rows of the smallest hashes of seed and key, on the executors. A sequence
    draw picks positions of sorted lists by a seeded generator, as lists that are published already do.
    """

    k_fake: int
    strata: tuple[str, ...] = ()
    k_real_cap: int | None = None
    exclude_tasks: tuple[str, ...] = ()
    seed: int = 0
    compressions: tuple[str, ...] | None = None
    draw: str = "hashed"

    def __post_init__(self) -> None:
        if self.draw not in DRAWS:
            raise ConfigError(f"unknown draw {self.draw!r}; known: {', '.join(DRAWS)}")
        for name in self.strata:
            if name not in STRATA:
                raise ConfigError(f"unknown stratum {name!r}; known: {', '.join(STRATA)}")
        if self.compressions is not None and not self.compressions:
            raise ConfigError("compressions must name at least one")


def _positions(
    rng: random.Random, sizes: Sequence[tuple[tuple[str, ...], int]], k: int
) -> list[tuple[str, ...]]:
    """1-based picks of the strata larger than `k`, drawn in the strata's order."""
    picks = []
    for stratum, n in sizes:
        picks += [(*stratum, p + 1) for p in rng.sample(range(n), k)]
    return picks


def benchmark(
    videos: DataFrame,
    spec: BenchmarkSpec,
    *,
    is_real: Column,
    task_rank: Mapping[str, int],
    pool_keys: DataFrame | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Draw a benchmark from the videos, or from those of `pool_keys` if there are any."""
    pool = videos
    if pool_keys is not None and pool_keys.head(1):
        pool = pool.join(pool_keys.select("key").distinct(), "key", "left_semi")
    if spec.exclude_tasks:
        pool = pool.where(~task_of(F.col("key")).isin(list(spec.exclude_tasks)))
    if spec.compressions is not None:
        pool = pool.where(F.col("compression").isin(list(spec.compressions)))
    rank = F.coalesce(
        *[F.when(task_of(F.col("key")) == t, F.lit(i)) for t, i in task_rank.items()], F.lit(-1)
    )
    strata = [f"_s{i}" for i in range(len(spec.strata))]
    keyed = pool.select(
        *KEY,
        is_real.alias("_real"),
        local_key(F.col("key")).alias("_local"),
        rank.alias("_rank"),
        F.coalesce("compression", F.lit("")).alias("_c"),
        *[
            F.coalesce(task_of(F.col("key")) if s == "task" else F.col(s), F.lit("")).alias(n)
            for s, n in zip(spec.strata, strata, strict=True)
        ],
    )
    unranked = keyed.where(F.col("_rank") < 0).head(1)
    if unranked:
        raise ContractError(f"the task of {unranked[0]['key']!r} has no rank")
    if spec.draw == "hashed":
        drawn = _hashed_draw(keyed, spec, strata)
    else:
        drawn = _sequence_draw(keyed, spec, strata, blocks)
    return all_test(drawn)


def _hashed_draw(keyed: DataFrame, spec: BenchmarkSpec, strata: Sequence[str]) -> DataFrame:
    """Fakes and reals of the smallest hashes of (seed, key, compression)."""
    text = F.concat_ws(":", F.lit(str(spec.seed)), "key", "_c")
    hashed = keyed.withColumn("_h", F.md5(text.cast("binary")))
    fakes, reals = hashed.where(~F.col("_real")), hashed.where("_real")
    picked = smallest_hashes(fakes, strata, "_h", spec.k_fake)
    n_reals = fakes.groupBy(*strata).count().agg(F.sum(F.least("count", F.lit(max(spec.k_fake, 0))))).first()[0] or 0
    if spec.k_real_cap is not None and spec.k_real_cap >= 0:
        n_reals = min(n_reals, spec.k_real_cap)
    return picked.select(*KEY).unionByName(smallest_hashes(reals, [], "_h", n_reals).select(*KEY))


def _sequence_draw(keyed: DataFrame, spec: BenchmarkSpec, strata: Sequence[str], blocks: int | None) -> DataFrame:
    """The draw of a seeded generator from sorted lists.

    Sampling a list picks positions, so only the sizes of strata that are larger than `k_fake`
    reach the driver; the positions drawn go back as a table and meet the rows by row number.
    Smaller strata are kept whole without being looked at.
    """
    order = ["_local", "_rank", "_c"]
    spark = keyed.sparkSession
    rng = random.Random(spec.seed)

    fakes = keyed.where(~F.col("_real"))
    n_fakes = 0
    drawn = []
    if spec.k_fake > 0:
        sizes = fakes.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
        totals = sizes.agg(F.sum(F.least("n", F.lit(spec.k_fake)))).first()
        n_fakes = int(totals[0] or 0)
        large = sizes.where(F.col("n") > spec.k_fake).orderBy(*strata) if strata else sizes.where(
            F.col("n") > spec.k_fake
        )
        listed = [(tuple(r[:-1]), r["n"]) for r in large.toLocalIterator()]
        picks = _positions(rng, listed, spec.k_fake)
        schema = ", ".join([*[f"{s} string" for s in strata], "rn long"])
        chosen = spark.createDataFrame(picks, schema)
        small = sizes.where(F.col("n") <= spec.k_fake).drop("n") if strata else None
        ranked = numbered(fakes, strata, order, blocks=blocks)
        if strata:
            drawn.append(fakes.join(small, strata, "left_semi").select(*KEY))
            drawn.append(ranked.join(chosen, [*strata, "rn"], "left_semi").select(*KEY))
        elif listed:
            drawn.append(ranked.join(chosen, "rn", "left_semi").select(*KEY))
        else:
            drawn.append(fakes.select(*KEY))

    reals = keyed.where(F.col("_real"))
    n_reals = reals.count()
    whole = range(n_reals)
    places = whole if n_reals <= n_fakes else rng.sample(whole, n_fakes)
    cap = spec.k_real_cap
    if cap is not None and 0 <= cap < len(places):
        places = rng.sample(places, cap)
    if len(places) == n_reals:
        drawn.append(reals.select(*KEY))
    elif places:
        chosen = spark.createDataFrame([(p + 1,) for p in places], "rn long")
        ranked = numbered(reals, [], order, blocks=blocks)
        drawn.append(ranked.join(chosen, "rn", "left_semi").select(*KEY))
    out = keyed.select(*KEY).limit(0)
    for part in drawn:
        out = out.unionByName(part)
    return out


# The rules' names.
RULES = ("all-test", "ident-72-14-14", "ident-80-20", "official", "official+ident-80-20", "benchmark")


def assign(
    rule: str,
    params: Mapping[str, object],
    videos: DataFrame,
    *,
    listed: DataFrame | None = None,
    is_real: Column | None = None,
    task_rank: Mapping[str, int] | None = None,
) -> DataFrame:
    """Assign splits by a rule's name and its parameters.

    A benchmark draws from the official test keys when `listed` has any, else from every video.
    """
    if rule in ("official", "official+ident-80-20") and listed is None:
        raise ConfigError(f"rule {rule!r} needs the publisher's split")
    if rule == "all-test":
        return all_test(videos)
    if rule == "ident-72-14-14":
        return carve_72_14_14(videos)
    if rule == "ident-80-20":
        return carve_80_20(videos)
    if rule == "official":
        return official(videos, listed)
    if rule == "official+ident-80-20":
        return official_plus_80_20(videos, listed, str(params.get("policy", POLICIES[0])))
    if rule == "benchmark":
        if is_real is None or task_rank is None:
            raise ConfigError("a benchmark needs `is_real` and `task_rank`")
        pool = None if listed is None else listed.where(F.col("split") == "test")
        spec = BenchmarkSpec(**params)
        return benchmark(videos, spec, is_real=is_real, task_rank=task_rank, pool_keys=pool)
    raise ConfigError(f"unknown rule {rule!r}; known: {', '.join(RULES)}")


def split_counts(splits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return splits.groupBy(*by, "split").agg(F.count(F.lit(1)).alias("n"))


def scheme_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """How many rows a scheme gained, lost and moved; one row."""
    a = old.select(*KEY, F.col("split").alias("old_split"))
    b = new.select(*KEY, F.col("split").alias("new_split"))
    both = join_null_safe(a, b, KEY, "full_outer")
    return both.agg(
        F.count_if(F.col("old_split").isNull()).alias("added"),
        F.count_if(F.col("new_split").isNull()).alias("removed"),
        F.count_if(F.col("old_split") != F.col("new_split")).alias("moved"),
    )
