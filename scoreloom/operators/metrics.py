"""Score metrics over any number of score tables at once.

Everything is read from a histogram: one row per (group, distinct score) with the counts of fakes
and reals. It is the only pass over the rows, it pre-aggregates before its shuffle, and all metrics
of a report share it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError
from scoreloom.operators.ordered import (
    join_null_safe,
    prefix_sums,
    weighted_quantiles,
)

CLIP = 1e-7


def score_hist(
    rows: DataFrame, groups: Sequence[str], score: str = "score", label: str = "label"
) -> DataFrame:
    """Counts of fakes (`pos`) and reals (`neg`) per group and distinct score."""
    y = F.col(label).cast("long")
    return rows.groupBy(*groups, F.col(score).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )


def roc_curve(hist: DataFrame, groups: Sequence[str]) -> DataFrame:
    """One row per distinct score with running counts from the top score down.

    `cum_pos`/`cum_neg` include the row, `n_pos`/`n_neg` are the group's totals; the point before
    a row is `cum - own`, so no lag is needed to interpolate between neighbours.
    """
    run = prefix_sums(
        hist,
        groups,
        ["score"],
        {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
        descending=True,
        totals={"cum_pos": "n_pos", "cum_neg": "n_neg"},
    )
    n_neg, n_pos = F.nullif(F.col("n_neg"), F.lit(0)), F.nullif(F.col("n_pos"), F.lit(0))
    return run.withColumns(
        {
            "fpr": F.col("cum_neg") / n_neg,
            "tpr": F.col("cum_pos") / n_pos,
            "fpr0": (F.col("cum_neg") - F.col("neg")) / n_neg,
            "tpr0": (F.col("cum_pos") - F.col("pos")) / n_pos,
        }
    )


@dataclass(frozen=True)
class Metric:
    """A named metric of the report.

    `source` says what `value` aggregates: "hist" rows, "curve" rows, or "plan" for a function
    from (hist, rows, groups) to one row per group with a `value` column.
    """

    name: str
    source: str
    value: Callable[..., object]
    two_class: bool = False
    params: dict[str, object] = field(default_factory=dict)


def _n() -> Column:
    return F.sum(F.col("pos") + F.col("neg"))


def auc() -> Metric:
    def value() -> Column:
        below = F.col("n_neg") - F.col("cum_neg")
        wins = F.sum(F.col("pos") * (below + F.col("neg") * F.lit(0.5)))
        return wins / F.nullif(F.max(F.col("n_pos") * F.col("n_neg")), F.lit(0))

    return Metric("auc", "curve", value, True)


def ap() -> Metric:
    def value() -> Column:
        precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
        return F.sum(F.col("pos") / F.nullif(F.col("n_pos"), F.lit(0)) * precision)

    return Metric("ap", "curve", value, True)


def _crossing() -> tuple[Column, Column]:
    """Whether a curve row ends the segment where FPR meets FNR, and how far along it they meet."""
    d0 = F.col("fpr0") - (1.0 - F.col("tpr0"))
    d1 = F.col("fpr") - (1.0 - F.col("tpr"))
    return (d1 >= 0.0) & (d0 < 0.0), -d0 / (d1 - d0)


def eer() -> Metric:
    def value() -> Column:
        here, t = _crossing()
        fpr = F.col("fpr0") + t * (F.col("fpr") - F.col("fpr0"))
        fnr = (1.0 - F.col("tpr0")) + t * (F.col("tpr0") - F.col("tpr"))
        return F.max(F.when(here, (fpr + fnr) / 2.0))

    return Metric("eer", "curve", value, True)


def eer_threshold() -> Metric:
    """The threshold at the equal error rate; the top score when it falls on the first segment."""

    def plan(hist: DataFrame, rows: DataFrame, groups: Sequence[str]) -> DataFrame:
        here, t = _crossing()
        curve = roc_curve(hist, groups)
        crossing = curve.where(here).select(
            *groups, F.col("score").alias("_s1"), t.alias("_t")
        )
        # the threshold before is the smallest score above; one more aggregate over the histogram,
        # with one crossing row per group on the other side of the join
        above = (
            join_null_safe(hist, crossing, groups)
            .where(F.col("score") > F.col("_s1"))
            .groupBy(*groups)
            .agg(F.min("score").alias("_s0"))
        )
        out = join_null_safe(crossing, above, groups, "left")
        s0 = F.coalesce(F.col("_s0"), F.col("_s1"))
        return out.select(*groups, (s0 + F.col("_t") * (F.col("_s1") - s0)).alias("value"))

    return Metric("eer_threshold", "plan", plan, True)


def acc(thr: float = 0.5) -> Metric:
    def value() -> Column:
        hit = F.when(F.col("score") >= F.lit(float(thr)), F.col("pos")).otherwise(F.col("neg"))
        return F.sum(hit) / _n()

    return Metric("acc", "hist", value, params={"thr": thr})


def _unit(name: str, x: float) -> float:
    if not 0.0 <= x <= 1.0:
        raise ConfigError(f"{name} must be between 0 and 1, got {x!r}")
    return float(x)


def tpr(fpr: float, interp: bool = False) -> Metric:
    """The largest TPR with FPR at most `fpr`, or the ROC curve interpolated there."""
    at_fpr = _unit("fpr", fpr)

    def value() -> Column:
        x = F.lit(at_fpr)
        if not interp:
            return F.greatest(
                F.max(F.when(F.col("fpr") <= x, F.col("tpr"))), F.max(F.col("tpr") * 0.0)
            )
        # the segment that leaves x; past the last point the curve stays at its end
        leaves = (F.col("fpr0") <= x) & (F.col("fpr") > x)
        slope = (F.col("tpr") - F.col("tpr0")) / (F.col("fpr") - F.col("fpr0"))
        at = F.col("tpr0") + slope * (x - F.col("fpr0"))
        return F.coalesce(F.max(F.when(leaves, at)), F.max("tpr"))

    return Metric("tpr", "curve", value, True, {"fpr": fpr, "interp": interp})


def fpr(tpr: float, interp: bool = False) -> Metric:
    """The smallest FPR with TPR at least `tpr`, or the ROC curve interpolated there."""
    at_tpr = _unit("tpr", tpr)

    def value() -> Column:
        x = F.lit(at_tpr)
        if not interp:
            if at_tpr == 0.0:
                return F.max(F.col("fpr") * 0.0)
            return F.min(F.when(F.col("tpr") >= x, F.col("fpr")))
        leaves = (F.col("tpr0") <= x) & (F.col("tpr") > x)
        slope = (F.col("fpr") - F.col("fpr0")) / (F.col("tpr") - F.col("tpr0"))
        at = F.col("fpr0") + slope * (x - F.col("tpr0"))
        return F.coalesce(F.max(F.when(leaves, at)), F.max("fpr"))

    return Metric("fpr", "curve", value, True, {"tpr": tpr, "interp": interp})


def brier() -> Metric:
    def value() -> Column:
        s = F.col("score")
        return F.sum(F.col("pos") * (s - 1.0) * (s - 1.0) + F.col("neg") * s * s) / _n()

    return Metric("brier", "hist", value)


def nll() -> Metric:
    def value() -> Column:
        p = F.least(F.greatest(F.col("score"), F.lit(CLIP)), F.lit(1.0 - CLIP))
        return -F.sum(F.col("pos") * F.ln(p) + F.col("neg") * F.ln(1.0 - p)) / _n()

    return Metric("nll", "hist", value)


def equal_width_bin(score: Column, bins: int) -> Column:
    """0-based bin of a score: the number of inner edges at or below it."""
    if bins < 1:
        raise ConfigError(f"bins must be a positive integer, got {bins!r}")
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)[1:-1]]
    return _bin_of(score, [F.lit(e) for e in edges])


def _bin_of(score: Column, edges: Sequence[Column]) -> Column:
    at = F.lit(0)
    for e in edges:
        at = at + (score >= e).cast("int")
    return at


def reliability(hist: DataFrame, groups: Sequence[str], bins: int = 15) -> DataFrame:
    """Points of the reliability curve: non-empty bins with count, mean score, share of fakes."""
    binned = hist.withColumn("bin", equal_width_bin(F.col("score"), bins))
    return _bin_means(binned, groups)


def _bin_means(binned: DataFrame, groups: Sequence[str]) -> DataFrame:
    w = F.col("pos") + F.col("neg")
    return binned.groupBy(*groups, "bin").agg(
        F.sum(w).alias("n"),
        (F.sum(F.col("score") * w) / F.sum(w)).alias("mean_score"),
        (F.sum("pos") / F.sum(w)).alias("fake_share"),
    )


def ece(bins: int = 15, adaptive: bool = False) -> Metric:
    """Expected calibration error over equal-width or equal-count bins."""

    def plan(hist: DataFrame, rows: DataFrame, groups: Sequence[str]) -> DataFrame:
        if adaptive:
            with_n = hist.withColumn("_w", F.col("pos") + F.col("neg"))
            probs = {f"_e{i}": float(q) for i, q in enumerate(np.linspace(0, 1, bins + 1)[1:-1], 1)}
            if not probs:
                binned = hist.withColumn("bin", F.lit(0))
            else:
                edges = weighted_quantiles(with_n, groups, "score", "_w", probs)
                joined = join_null_safe(hist, edges, groups)
                binned = joined.withColumn(
                    "bin", _bin_of(F.col("score"), [F.col(e) for e in probs])
                )
            points = _bin_means(binned, groups)
        else:
            points = reliability(hist, groups, bins)
        gap = F.col("n") * F.abs(F.col("mean_score") - F.col("fake_share"))
        return points.groupBy(*groups).agg((F.sum(gap) / F.sum("n")).alias("value"))

    return Metric("ece", "plan", plan, params={"bins": bins, "adaptive": adaptive})


ROW_ORDER = ("dataset", "key", "compression")


def by_confidence(rows: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Rows with _less (minus their confidence), _y and _err (1 where wrong), and the columns that
    order them from the most confident one down, ties in key order."""
    ties = [c for c in ROW_ORDER if c in rows.columns]
    ordered = rows.select(
        *groups,
        (-F.greatest(F.col("score"), 1.0 - F.col("score"))).alias("_less"),
        *[F.coalesce(F.col(c), F.lit("")).alias(f"_t_{c}") for c in ties],
        F.col("label").alias("_y"),
        ((F.col("score") >= 0.5).cast("int") != F.col("label")).cast("long").alias("_err"),
    )
    return ordered, ["_less", *[f"_t_{c}" for c in ties]]


def risk_coverage(
    rows: DataFrame, groups: Sequence[str], *, blocks: int | None = None
) -> DataFrame:
    """Points (coverage, risk) from the most confident row down, ties in key order.

    Rows are needed here, not the histogram: equal confidences keep the table's key order. Ranges of
    the whole order split even a run of equal confidences.
    """
    ordered, order = by_confidence(rows, groups)
    run = prefix_sums(
        ordered,
        groups,
        order,
        {"_k": F.lit(1), "_e": F.col("_err")},
        totals={"_k": "_n"},
        ranges=True,
        blocks=blocks,
    )
    return run.select(
        *groups,
        F.col("_k").alias("k"),
        (F.col("_k") / F.col("_n")).alias("coverage"),
        (F.col("_e") / F.col("_k")).alias("risk"),
    )


def aurc(*, blocks: int | None = None) -> Metric:
    """Mean risk over every coverage level."""

    def plan(hist: DataFrame, rows: DataFrame, groups: Sequence[str]) -> DataFrame:
        points = risk_coverage(rows, groups, blocks=blocks)
        return points.groupBy(*groups).agg(F.avg("risk").alias("value"))

    return Metric("aurc", "plan", plan)


# The built-in names; `register` adds to them.
REGISTRY: dict[str, Callable[..., Metric]] = {
    "auc": auc,
    "ap": ap,
    "eer": eer,
    "acc": acc,
    "tpr": tpr,
    "fpr": fpr,
    "ece": ece,
    "brier": brier,
    "nll": nll,
    "aurc": aurc,
}


def register(name: str, value: Callable[[], Column], *, two_class: bool = False) -> None:
    """Add a metric that aggregates histogram columns `score`, `pos` and `neg`."""
    if name in REGISTRY:
        raise ConfigError(f"metric {name!r} is already registered")
    REGISTRY[name] = lambda: Metric(name, "hist", value, two_class)


def metric(name: str, **params: object) -> Metric:
    if name not in REGISTRY:
        raise ConfigError(f"unknown metric {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**params)


def compute(
    rows: DataFrame,
    groups: Sequence[str],
    metrics: dict[str, Metric],
    *,
    hist: DataFrame | None = None,
) -> DataFrame:
    """One row per group: its counts, one column per metric, and why two-class ones are undefined.

    Histogram and curve metrics each take one aggregate however many are asked for. `rows` is read
    again only by metrics that need the rows themselves. A group with no row has no histogram and
    so no line here; reports join the groups back.
    """
    groups = list(groups)
    if not groups:
        whole = None if hist is None else hist.withColumn("_all", F.lit(0))
        return compute(rows.withColumn("_all", F.lit(0)), ["_all"], metrics, hist=whole).drop("_all")
    hist = score_hist(rows, groups) if hist is None else hist
    curve_cols = [m.value().alias(k) for k, m in metrics.items() if m.source == "curve"]
    hist_cols = [m.value().alias(k) for k, m in metrics.items() if m.source == "hist"]
    counts = [F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg")]
    if curve_cols:
        out = roc_curve(hist, groups).groupBy(*groups).agg(*counts, *hist_cols, *curve_cols)
    else:
        out = hist.groupBy(*groups).agg(*counts, *hist_cols)
    for k, m in metrics.items():
        if m.source == "plan":
            part = m.value(hist, rows, groups).withColumnRenamed("value", k)
            out = join_null_safe(out, part, groups, "left")
    one_class = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    for k, m in metrics.items():
        if m.two_class:
            out = out.withColumn(k, F.when(~one_class, F.col(k)))
    reason = F.when(F.col("n_neg") == 0, "every label is fake").when(
        F.col("n_pos") == 0, "every label is real"
    )
    return out.select(*groups, "n_pos", "n_neg", *metrics, reason.alias("undefined"))


def roc_points(hist: DataFrame, groups: Sequence[str]) -> DataFrame:
    """ROC points per group, led by (0, 0) at an infinite threshold; one-class groups have none."""
    curve = roc_curve(hist, groups).where((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    start = (
        hist.groupBy(*groups)
        .agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
        .where((F.col("_p") > 0) & (F.col("_q") > 0))
        .select(
            *groups,
            F.lit(0.0).alias("fpr"),
            F.lit(0.0).alias("tpr"),
            F.lit(float("inf")).alias("threshold"),
        )
    )
    return curve.select(*groups, "fpr", "tpr", F.col("score").alias("threshold")).unionByName(start)


def det_points(hist: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Points of the DET curve: error rates kept at 1e-4 or more, for logarithmic axes."""

    def inside(x: Column) -> Column:
        return F.greatest(F.least(x, F.lit(1.0)), F.lit(1e-4))

    points = roc_points(hist, groups)
    return points.select(
        *groups, inside(F.col("fpr")).alias("fpr"), inside(1.0 - F.col("tpr")).alias("fnr")
    )


def input_problems(rows: DataFrame, groups: Sequence[str], *, bounded: bool = True) -> DataFrame:
    """Counts of what makes a group's scores or labels unusable, and of each class."""
    s, y = F.col("score"), F.col("label")
    finite = ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))
    outside = finite & ((s < 0.0) | (s > 1.0)) if bounded else F.lit(False)
    return rows.groupBy(*groups).agg(
        F.count_if(F.isnan(s)).alias("n_nan"),
        F.count_if(F.abs(s) == F.lit(float("inf"))).alias("n_inf"),
        F.count_if(outside).alias("n_out_of_range"),
        F.count_if(s.isNull()).alias("n_null"),
        F.count_if(y.isNull() | ~y.isin(0, 1)).alias("n_bad_label"),
        F.count_if(y == 1).alias("n_pos"),
        F.count_if(y == 0).alias("n_neg"),
    )
