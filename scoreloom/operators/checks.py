"""Data checks: each one returns the rows or counts that break a rule."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.keys import leaks_local_path
from scoreloom.operators.ordered import join_null_safe


def key_counts(rows: DataFrame, keys: Sequence[str], **more: Column) -> DataFrame:
    """How many rows share a key; partial counts keep a repeated key from becoming a hot spot."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()]
    )


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return key_counts(rows, keys).where(F.col("n") > 1)


def inventory_problems(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """(key, problem) for keys not of the form task/id, unknown tasks, label keys of another task,
    and repeated (key, compression). `tasks` maps task to label_key, one row per task."""
    task = F.substring_index("key", "/", 1)
    known = tasks.select(F.col("task").alias("_task"), F.col("label_key").alias("_label"))
    joined = rows.join(known, task == F.col("_task"), "left")
    rules = F.array(
        F.when(~F.col("key").rlike("^[^/]+/.+$"), F.lit("key is not task/id")),
        F.when(F.col("_task").isNull(), F.lit("unknown task")),
        F.when(
            F.col("label_key") != F.coalesce("_label", task), F.lit("label key of another task")
        ),
    )
    each = joined.select("key", F.explode(F.array_compact(rules)).alias("problem"))
    twice = repeated_keys(rows, ["key", "compression"])
    return each.unionByName(twice.select("key", F.lit("listed more than once").alias("problem")))


def lint_release(
    videos: DataFrame,
    vocab: DataFrame,
    compressions: Sequence[str],
    splits: DataFrame,
    pairs: DataFrame,
) -> DataFrame:
    """One row per problem of a release's lists: (severity, place, message, example)."""
    key = ["key", "compression"]

    def issue(rows: DataFrame, place: str, message: str, example: str) -> DataFrame:
        return rows.select(
            F.lit("error").alias("severity"),
            F.lit(place).alias("place"),
            F.lit(message).alias("message"),
            F.col(example).alias("example"),
        )

    c = F.col("compression")
    leaks = reduce(
        lambda a, b: a | b,
        [F.coalesce(leaks_local_path(F.col(n)), F.lit(False)) for n, t in videos.dtypes if t == "string"],
    )
    strangers = videos.join(vocab.select("label_key"), "label_key", "left_anti")
    known = videos.select("key").distinct()
    ends = pairs.select(F.col("real_key").alias("key")).unionAll(pairs.select("fake_key"))
    parts = [
        issue(repeated_keys(videos, key), "videos", "listed more than once", "key"),
        issue(strangers, "videos", "unknown label key", "key"),
        issue(
            videos.where(c.isNotNull() & ~c.isin(list(compressions))),
            "videos", "unlisted compression", "key",
        ),
        issue(videos.where(leaks), "videos", "local path", "key"),
        issue(repeated_keys(splits, key), "splits", "listed more than once", "key"),
        issue(
            join_null_safe(splits, videos.select(*key).distinct(), key, "left_anti"),
            "splits", "not a listed video", "key",
        ),
        issue(ends.join(known, "key", "left_anti"), "pairs", "not a listed video", "key"),
    ]
    return reduce(DataFrame.unionByName, parts)


def card_problems(
    rows: DataFrame, place: str, found: str, recorded: str | None, counts: DataFrame, card_counts: DataFrame
) -> DataFrame:
    """Where a card's fingerprint or counts per split differ from the list's own."""
    spark = rows.sparkSession
    out = []
    if recorded is not None and recorded != found:
        out.append(("error", place, f"fingerprint is {found}, the card says {recorded}"))
    table = spark.createDataFrame(out, "severity string, place string, message string")
    a = counts.select("split", F.col("n").alias("_n"))
    b = card_counts.select("split", F.col("n").alias("_c"))
    wrong = a.join(b, "split", "full_outer").where(~F.col("_n").eqNullSafe(F.col("_c")))
    text = F.format_string(
        "split %s holds %d rows, the card says %d",
        "split", F.coalesce("_n", F.lit(0)), F.coalesce("_c", F.lit(0)),
    )
    return table.unionByName(
        wrong.select(F.lit("error").alias("severity"), F.lit(place).alias("place"), text.alias("message"))
    )
