"""Coverage of score tables and clip-to-video reduction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError
from scoreloom.functions.scores import apply_missing_policy, logit, sigmoid
from scoreloom.operators.ordered import join_null_safe, weighted_quantiles

AGGREGATION_CLIP = 1e-7
# Clips of a video whose scores are sorted in one row; those of longer videos are ranked over blocks.
SORTED_CLIPS = 4096


def coverage(rows: DataFrame, groups: Sequence[str], minimum: float | None = None) -> DataFrame:
    """Counts by status and the share scored; nothing expected counts as fully covered."""
    counts = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("expected"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "missing", "error")],
    )
    share = F.coalesce(F.col("ok") / F.nullif(F.col("expected"), F.lit(0)), F.lit(1.0))
    out = counts.withColumn("coverage", share)
    return out if minimum is None else out.withColumn("meets", F.col("coverage") >= F.lit(minimum))


def status_cells(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts per (keys, status, label, score): the one pass a whole report is read from.

    Coverage and every histogram of a report are sums over these cells, so their plans share this
    aggregate's exchange and the rows are scanned once.
    """
    return rows.groupBy(*keys, "status", "label", "score").agg(F.count(F.lit(1)).alias("n"))


def cells_hist(cells: DataFrame, groups: Sequence[str], missing: str = "exclude") -> DataFrame:
    """The score histogram of cells under a missing-score policy."""
    y, n = F.col("label").cast("long"), F.col("n")
    return apply_missing_policy(cells, missing).groupBy(*groups, "score").agg(
        F.sum(y * n).alias("pos"), F.sum((1 - y) * n).alias("neg")
    )


def cells_coverage(
    cells: DataFrame, groups: Sequence[str], minimum: float | None = None
) -> DataFrame:
    """The coverage of cells, as `coverage` gives it for rows."""
    n = F.col("n")
    counts = cells.groupBy(*groups).agg(
        F.sum(n).alias("expected"),
        *[
            F.coalesce(F.sum(F.when(F.col("status") == s, n)), F.lit(0)).alias(s)
            for s in ("ok", "missing", "error")
        ],
    )
    out = counts.withColumn("coverage", F.col("ok") / F.col("expected"))
    return out if minimum is None else out.withColumn("meets", F.col("coverage") >= F.lit(minimum))


def clip_to_video(
    clips: DataFrame,
    keys: Sequence[str],
    mode: str = "mean-prob",
    *,
    thr: float = 0.5,
    more: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One score per video from its clip scores, with `more` aggregates beside it.

    All modes but the median aggregate partially before the shuffle, so a video holding most of the
    clips is no hot spot. The median sorts the scores of a video of up to `SORTED_CLIPS` clips in its
    row; longer videos are found first by a count, and their (video, score) histogram is ranked over
    blocks.
    """
    s = F.col("score")
    if mode == "median":
        return _medians(clips, keys, {"n_clips": F.count(F.lit(1)), **(more or {})})
    modes: dict[str, Column] = {
        "mean-prob": F.avg(s),
        "mean-logit": sigmoid(F.avg(logit(s, AGGREGATION_CLIP))),
        "max": F.max(s),
        "vote": F.avg(F.when(s >= F.lit(float(thr)), 1.0).otherwise(0.0)),
    }
    if mode not in modes:
        raise ConfigError(f"unknown aggregation {mode!r}; known: median, {', '.join(modes)}")
    return clips.groupBy(*keys).agg(
        modes[mode].alias("score"),
        F.count(F.lit(1)).alias("n_clips"),
        *[c.alias(k) for k, c in (more or {}).items()],
    )


def _medians(clips: DataFrame, keys: Sequence[str], more: Mapping[str, Column]) -> DataFrame:
    extra = [c.alias(k) for k, c in more.items()]
    sizes = clips.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    # at most one row for every SORTED_CLIPS clips
    long = sizes.where(F.col("_size") > SORTED_CLIPS).drop("_size")
    sorted_scores = F.sort_array(F.filter(F.collect_list("score"), lambda x: x.isNotNull()))
    of_short = join_null_safe(clips, long, keys, "left_anti").groupBy(*keys).agg(sorted_scores.alias("_s"), *extra)
    n = F.size("_s")
    low, high = F.get("_s", F.floor((n - 1) / 2).cast("int")), F.get("_s", F.floor(n / 2).cast("int"))
    half = F.when(n % 2 == 1, F.lit(0.0)).otherwise(F.lit(0.5))
    short = of_short.select(*keys, (low + (high - low) * half).alias("score"), *more)

    of_long = join_null_safe(clips, long, keys, "left_semi")
    hist = of_long.where(F.col("score").isNotNull()).groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_w"))
    median = weighted_quantiles(hist, keys, "score", "_w", {"score": 0.5})
    counts = of_long.groupBy(*keys).agg(*extra)
    return short.unionByName(join_null_safe(counts, median, keys, "left").select(*keys, "score", *more))
