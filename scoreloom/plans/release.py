"""Release jobs: compare two releases, build a dataset's lists, rebuild and check them."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators import fingerprint as FP
from scoreloom.operators import pairs as P
from scoreloom.operators import records as R
from scoreloom.operators import splits as S
from scoreloom.operators.checks import repeated_keys
from scoreloom.operators.joins import ROW_KEY
from scoreloom.operators.ordered import join_null_safe
from scoreloom.session import materialized


def dataset_bumps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per dataset, what changed between two video lists and the release bump it asks for.

    One join classifies every key: a relabelled or removed video is major, an added one minor.
    """
    a = old.select(*ROW_KEY, F.col("label_key").alias("_la"), F.col("method").alias("_ma"))
    b = new.select(*ROW_KEY, F.col("label_key").alias("_lb"), F.col("method").alias("_mb"))
    both = join_null_safe(a, b, ROW_KEY, "full_outer")
    changed = (F.col("_la") != F.col("_lb")) | (F.col("_ma") != F.col("_mb"))
    counts = both.groupBy("dataset").agg(
        F.count_if(changed).alias("relabelled"),
        F.count_if(F.col("_la").isNull()).alias("added"),
        F.count_if(F.col("_lb").isNull()).alias("removed"),
    )
    bump = (
        F.when((F.col("relabelled") > 0) | (F.col("removed") > 0), "major")
        .when(F.col("added") > 0, "minor")
        .otherwise("none")
    )
    return counts.withColumn("bump", bump)


@dataclass(frozen=True)
class Built:
    """A dataset's lists: portable videos, a split list per scheme, pairs, and what fits them."""

    videos: DataFrame
    schemes: dict[str, DataFrame]
    pairs: DataFrame
    fingerprints: DataFrame


def list_fingerprints(
    videos: DataFrame, schemes: Mapping[str, DataFrame], pairs: DataFrame
) -> DataFrame:
    """(list, n, fingerprint) of the videos, the pairs and every scheme."""
    tables = {
        "videos": FP.fingerprint(videos, FP.json_line(videos.columns)),
        "pairs": FP.fingerprint(pairs.distinct(), FP.json_line(pairs.columns)),
        **{f"scheme:{k}": FP.fingerprint(v, FP.split_line()) for k, v in schemes.items()},
    }
    return reduce(
        DataFrame.unionByName, [t.withColumn("list", F.lit(k)) for k, t in tables.items()]
    )


def build_dataset(
    records: DataFrame,
    schemes: Mapping[str, tuple[str, Mapping[str, object]]],
    *,
    is_real: Column,
    candidates: Column,
    task_rank: Mapping[str, int],
    pairing_rule: str | None,
    fanout: int | None = None,
    listed: DataFrame | None = None,
    local_attrs: Sequence[str] = (),
) -> Built:
    """All lists of a dataset from its inventory: one plan per list, none run yet.

    `schemes` names a rule and its parameters per scheme.
    """
    splits = {
        name: S.assign(rule, params, records, listed=listed, is_real=is_real, task_rank=task_rank)
        for name, (rule, params) in schemes.items()
    }
    if pairing_rule is None:
        pairs = records.sparkSession.createDataFrame([], "fake_key string, real_key string, rule string")
    else:
        pairs = P.resolve_pairs(
            records, is_real=is_real, candidates=candidates, fanout_cap=fanout,
            rule=pairing_rule, task_rank=task_rank,
        )
    columns = [c for c in R.RECORD_FIELDS if c in records.columns]
    if "attrs" in records.columns:
        columns.append("attrs")
    videos = R.portable(records, local_attrs).select(*columns)
    return Built(videos, splits, pairs, list_fingerprints(videos, splits, pairs))


def rebuild_report(
    built: Built, published: DataFrame, card_counts: DataFrame, compressions: Sequence[str] = ()
) -> DataFrame:
    """Each list's fingerprint against the published one, with counts and the likely cause.

    `published` holds (list, fingerprint); `card_counts` holds (list, split, n). One row per list,
    `matches` true where nothing differs.
    """
    rows = None
    for name, split in built.schemes.items():
        counts = S.split_counts(split).withColumn("list", F.lit(f"scheme:{name}"))
        rows = counts if rows is None else rows.unionByName(counts)
    sums = built.fingerprints.select("list", F.col("n").alias("rebuilt_rows"), "fingerprint")
    card = card_counts.groupBy("list").agg(F.sum("n").alias("published_rows"))
    joined = (
        published.select("list", F.col("fingerprint").alias("_published"))
        .join(sums, "list", "left")
        .join(card, "list", "left")
    )
    if rows is not None:
        mine = rows.select("list", "split", F.col("n").alias("_mine"))
        theirs = card_counts.select("list", "split", F.col("n").alias("_theirs"))
        moved = mine.join(theirs, ["list", "split"], "full_outer").groupBy("list").agg(
            F.count_if(~F.col("_mine").eqNullSafe(F.col("_theirs"))).alias("splits_off")
        )
        joined = joined.join(moved, "list", "left")
    else:
        joined = joined.withColumn("splits_off", F.lit(0))
    held = built.videos.select("compression").distinct()
    lacking = (
        built.videos.sparkSession.createDataFrame([(c,) for c in compressions], "compression string")
        .join(held, "compression", "left_anti")
        .agg(F.count(F.lit(1)).alias("_lacking"), F.lit(0).alias("_k"))
    )
    joined = joined.withColumn("_k", F.lit(0)).join(lacking, "_k")
    same = F.col("fingerprint").eqNullSafe(F.col("_published"))
    fewer = F.col("rebuilt_rows") < F.col("published_rows")
    more = F.col("rebuilt_rows") > F.col("published_rows")
    cause = (
        F.when(same, F.lit(None).cast("string"))
        .when(F.col("_lacking") > 0, "a listed compression has no video")
        .when(fewer, "videos of the release are lacking")
        .when(more, "videos the release does not have")
        .otherwise("same numbers, other rows or fields")
    )
    return joined.select(
        "list", same.alias("matches"), "rebuilt_rows", "published_rows", "splits_off",
        cause.alias("cause"),
    )


def held(built: Built) -> Built:
    """The same lists, computed and kept in the shared folder, where everything reads them."""
    videos, pairs = materialized(built.videos, "videos"), materialized(built.pairs, "pairs")
    schemes = {k: materialized(v, f"scheme-{k}") for k, v in built.schemes.items()}
    return Built(videos, schemes, pairs, list_fingerprints(videos, schemes, pairs))


def write_dataset(built: Built, path: str, card: Mapping[str, object]) -> None:
    """Write every list, checked first, and the card last: readers start from the card.

    Raises when a video is listed twice or a split row names no video. Lists are computed once, into
    the shared folder, and checked, fingerprinted and written from there.
    """
    built = held(built)
    key = list(R.KEY)
    R.require_empty(repeated_keys(built.videos, key), "video listed twice")
    for name, split in built.schemes.items():
        strangers = join_null_safe(split, built.videos.select(*key), key, "left_anti")
        R.require_empty(strangers, f"split row of {name} names no video")
    built.videos.write.mode("overwrite").parquet(f"{path}/videos")
    built.pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    parts = [v.withColumn("scheme", F.lit(k)) for k, v in built.schemes.items()]
    if parts:
        table = reduce(DataFrame.unionByName, parts)
        table.write.mode("overwrite").partitionBy("scheme").parquet(f"{path}/splits")
    built.fingerprints.write.mode("overwrite").parquet(f"{path}/fingerprints")
    spark = built.videos.sparkSession
    text = json.dumps(dict(card), sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/card"
    )


def publish(built: Built, root: str, version: str, expected: DataFrame) -> str:
    """Write a rebuilt dataset under its version and point readers at it, or leave all as it was.

    The pointer is written only after the written lists, read back, have the expected fingerprints;
    a failed write leaves an unreferenced folder and the old pointer.
    """
    spark = built.videos.sparkSession
    path = f"{root}/{version}"
    write_dataset(built, path, {"version": version})
    splits = spark.read.parquet(f"{path}/splits") if built.schemes else None
    schemes = {k: splits.where(F.col("scheme") == k).drop("scheme") for k in built.schemes}
    found = list_fingerprints(
        spark.read.parquet(f"{path}/videos").select(*built.videos.columns),
        schemes,
        spark.read.parquet(f"{path}/pairs").select(*built.pairs.columns),
    )
    both = expected.select("list", F.col("fingerprint").alias("_e")).join(found, "list", "left")
    off = both.where(~F.col("_e").eqNullSafe(F.col("fingerprint")))
    R.require_empty(off, "fingerprint differs from the expected one")
    pointer = spark.createDataFrame([(version,)], "value string")
    pointer.coalesce(1).write.mode("overwrite").text(f"{root}/current")
    return path


def current(spark: SparkSession, root: str) -> str:
    """The folder of the published version."""
    return f"{root}/{spark.read.text(f'{root}/current').first()['value']}"


# What a release publishes by row: the columns that name a list, those that name a row of it, and what
# a row says.
LISTS = {
    "videos": (["dataset"], ["key", "compression"], ["label_key", "method"]),
    "scheme": (["dataset", "scheme"], ["key", "compression"], ["split"]),
    "labels": (["dataset", "mapping"], ["label_key"], ["value"]),
}


def list_digests(rows: DataFrame, kind: str) -> DataFrame:
    """(dataset, name, n, digest) of every list of a kind: its rows, and the sum of their hashes.

    Sums merge over tasks in any order, so a list is digested where it lies and never sorted or joined.
    """
    lists, names, says = LISTS[kind]
    row = F.xxhash64(*[F.coalesce(F.col(c), F.lit("\x00")) for c in [*names, *says]]).cast("decimal(38,0)")
    name = F.col(lists[1]) if len(lists) > 1 else F.lit("")
    return rows.groupBy("dataset", name.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("digest"))


def list_changes(old: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """(dataset, kind, name, change, added, removed, changed) of the lists of two releases that differ.

    Digests say which lists are new, removed or changed. Only rows of changed lists are joined.
    """
    lists, names, says = LISTS[kind]
    a = list_digests(old, kind).select("dataset", "name", F.struct("n", "digest").alias("_a"))
    b = list_digests(new, kind).select("dataset", "name", F.struct("n", "digest").alias("_b"))
    both = a.join(b, ["dataset", "name"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").otherwise("changed")
    found = both.select("dataset", "name", change.alias("change"))
    which = found.where("change = 'changed'").select("dataset", "name")
    keys = ["dataset", "name", *names]

    def rows(table: DataFrame, side: str) -> DataFrame:
        named = table.withColumn("name", F.col(lists[1]) if len(lists) > 1 else F.lit(""))
        return named.join(which, ["dataset", "name"], "left_semi").select(*keys, F.struct(*says).alias(side))

    met = join_null_safe(rows(old, "_old"), rows(new, "_new"), keys, "full_outer")
    counts = met.groupBy("dataset", "name").agg(
        F.count_if(F.col("_old").isNull()).alias("added"),
        F.count_if(F.col("_new").isNull()).alias("removed"),
        F.count_if(F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("changed"),
    )
    return found.join(counts, ["dataset", "name"], "left").select("dataset", F.lit(kind).alias("kind"), "name", "change", "added", "removed", "changed")


def release_changes(old: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> DataFrame:
    """Every list that differs between two releases, with the bump it asks for.

    A release maps "videos", "scheme" and "labels" to its rows, columns as in `LISTS`. What breaks
    results is major: a list removed, a video list or scheme changed, a label that maps to another value
    or to none. What adds is minor: a new list, a mapping that only gained labels. Lists of a dataset
    that is new itself are new lists.
    """
    out = None
    for kind in LISTS:
        part = list_changes(old[kind], new[kind], kind)
        out = part if out is None else out.unionByName(part)
    only_more = (F.col("kind") == "labels") & (F.col("removed") == 0) & (F.col("changed") == 0)
    bump = F.when((F.col("change") == "new") | (F.col("change") == "changed") & only_more, "minor").otherwise("major")
    return out.withColumn("bump", bump)


def required_bump(changes: DataFrame, datasets: DataFrame) -> DataFrame:
    """The bump that each of `datasets` (dataset) asks for: its most breaking change, `none` without any."""
    worst = changes.groupBy("dataset").agg(F.when(F.bool_or(F.col("bump") == "major"), "major").otherwise("minor").alias("bump"))
    return datasets.select("dataset").distinct().join(worst, "dataset", "left").select("dataset", F.coalesce("bump", F.lit("none")).alias("bump"))
