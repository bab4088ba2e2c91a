"""Calibration maps fitted on histograms."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError, ContractError
from scoreloom.functions.scores import logit, sigmoid, softplus
from scoreloom.operators import metrics as M
from scoreloom.operators.ordered import QUANTILE_BLOCKS, carried_forward, numbered, with_quantile_block
from scoreloom.session import materialized

# Where the temperature is searched, and how fine.
T_LOW, T_HIGH, T_STEP = 0.05, 20.0, 1e-6
METHODS = ("temperature", "platt", "isotonic")


@dataclass(frozen=True)
class Calibration:
    """A fitted map from scores to scores; `knots` holds (x, y) of an isotonic one."""

    method: str
    params: dict[str, float] = field(default_factory=dict)
    knots: DataFrame | None = None


def _loss(z: Column) -> Column:
    """Summed cross-entropy of histogram cells whose logit is `z`."""
    return F.sum(F.col("pos") * softplus(-z) + F.col("neg") * softplus(z))


def fit_temperature(hist: DataFrame, *, probes: int = 64) -> Calibration:
    """The T in [0.05, 20] with the least cross-entropy of logit(p) / T.

    The loss has a single minimum, so each pass scores a whole grid of temperatures in one
    aggregate and keeps the two steps around the best: five small jobs instead of one per probe.
    """
    cells = hist.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cells = cells.withColumn("_z", logit(F.col("score"))).persist()
    try:
        low, high = T_LOW, T_HIGH
        while high - low >= T_STEP:
            grid = [float(t) for t in np.linspace(low, high, probes)]
            each = F.explode(F.array(*[F.lit(t) for t in grid])).alias("t")
            losses = cells.select("*", each).groupBy("t").agg(_loss(F.col("_z") / F.col("t")).alias("l"))
            best = grid.index(losses.agg(F.min_by("t", "l")).first()[0])
            low, high = grid[max(best - 1, 0)], grid[min(best + 1, probes - 1)]
        return Calibration("temperature", {"T": (low + high) / 2.0})
    finally:
        cells.unpersist()


def fit_platt(hist: DataFrame, *, max_iter: int = 100, tol: float = 1e-12) -> Calibration:
    """Logistic regression of the label on logit(p) by Newton steps of five sums each."""
    cells = hist.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cells = cells.select("pos", "neg", logit(F.col("score")).alias("x")).persist()
    ridge = 1e-10
    a, b = 1.0, 0.0
    try:
        for _ in range(max_iter):
            p = sigmoid(F.col("x") * a + b)
            n = F.col("pos") + F.col("neg")
            gap, w, x = n * p - F.col("pos"), n * p * (1.0 - p), F.col("x")
            total, ga, gb, aa, ab, bb = cells.agg(
                F.sum(n), F.sum(gap * x), F.sum(gap), F.sum(w * x * x), F.sum(w * x), F.sum(w)
            ).first()
            hessian = np.array([[aa / total + ridge, ab / total], [ab / total, bb / total + ridge]])
            if abs(np.linalg.det(hessian)) < 1e-18:
                break
            da, db = np.linalg.solve(hessian, np.array([ga, gb]) / total)
            a, b = a - float(da), b - float(db)
            if abs(da) < tol and abs(db) < tol:
                break
        return Calibration("platt", {"a": a, "b": b})
    finally:
        cells.unpersist()


# Ranges of cells that are pooled at once, and how many of them meet in a task of the next level.
_MEET = 16
_POOLED = "place long, low double, high double, pos double, n double"


def _pool(table: pa.Table) -> pa.Table:
    """Neighbouring blocks pooled until their shares of fakes rise: one pass with a stack."""
    rows = table.sort_by("low").to_pydict()
    low, high, pos, n = [], [], [], []
    for x0, x1, p, w in zip(rows["low"], rows["high"], rows["pos"], rows["n"]):
        while pos and pos[-1] * w >= p * n[-1]:
            x0, p, w = low.pop(), p + pos.pop(), w + n.pop()
            high.pop()
        for stack, v in ((low, x0), (high, x1), (pos, p), (n, w)):
            stack.append(v)
    place = [rows["place"][0]] * len(low)
    return pa.table({"place": pa.array(place, pa.int64()), **{c: pa.array(v, pa.float64()) for c, v in (("low", low), ("high", high), ("pos", pos), ("n", n))}})


def fit_isotonic(hist: DataFrame) -> Calibration:
    """Non-decreasing least-squares fit of the fake share, weighted by count.

    Cells are pooled range by range. Pooling what is pooled already, over several ranges at once, gives
    the blocks of all their cells, so ranges meet in a tree. What grows with the table are the blocks
    that are left, as few as shares of fakes go up. The knots are the ends of the blocks, as a table.
    """
    cells = hist.groupBy("score").agg(F.sum("pos").cast("double").alias("pos"), F.sum("neg").alias("neg"))
    blocks = with_quantile_block(cells, [], "score", [F.col("pos"), F.col("neg")]).select(
        F.col("_block").cast("long").alias("place"), F.col("score").alias("low"), F.col("score").alias("high"), "pos",
        (F.col("pos") + F.col("neg")).alias("n"),
    )
    width = QUANTILE_BLOCKS
    while True:
        blocks = blocks.groupBy("place").applyInArrow(_pool, _POOLED)
        if width == 1:
            break
        width = -(-width // _MEET)
        blocks = blocks.withColumn("place", F.floor(F.col("place") / _MEET))
    share = F.least(F.greatest(F.col("pos") / F.col("n"), F.lit(0.0)), F.lit(1.0))
    ends = F.explode(F.array_distinct(F.array("low", "high"))).alias("x")
    return Calibration("isotonic", {}, materialized(blocks.select(ends, share.alias("y")), "knots"))


def _interpolated(knots: DataFrame, scores: DataFrame, column: str) -> DataFrame:
    """Scores read off the line through the knots, flat beyond the ends.

    Each distinct score finds the knot before it and the one after that by one ordered pass over both.
    """
    order = numbered(knots, [], ["x"], "_i")
    after = order.select((F.col("_i") - 1).alias("_i"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    pieces = order.join(after, "_i", "left").select(F.col("x").alias("_at"), F.struct("x", "y", "x1", "y1").alias("_knot"))
    asked = scores.select(F.col(column).alias("_at")).where(F.col(column).isNotNull()).distinct()
    both = pieces.withColumn("_asked", F.lit(0)).unionByName(asked.withColumn("_asked", F.lit(1)), allowMissingColumns=True)
    # a knot comes before a score at its place
    found = carried_forward(both, ["_at", "_asked"], F.col("_knot"), "_last").where("_asked = 1")
    k = F.col("_last")
    line = k["y"] + (F.col("_at") - k["x"]) / (k["x1"] - k["x"]) * (k["y1"] - k["y"])
    first = knots.agg(F.min_by("y", "x").alias("_first"))  # one row
    value = F.when(k.isNull(), F.col("_first")).when(k["x1"].isNull(), k["y"]).otherwise(line)
    read = found.join(F.broadcast(first)).select("_at", value.alias("_value"))
    return scores.join(read, F.col(column) == F.col("_at"), "left").withColumn(column, F.col("_value")).drop("_at", "_value")


def fit(method: str, rows: DataFrame) -> Calibration:
    """Fit a method on rows with `score` and `label`."""
    if method not in METHODS:
        raise ConfigError(f"unknown calibration {method!r}; known: {', '.join(METHODS)}")
    hist = M.score_hist(rows, [])
    if not hist.head(1):
        raise ContractError("no rows to fit a calibration on")
    return {"temperature": fit_temperature, "platt": fit_platt, "isotonic": fit_isotonic}[method](hist)


def apply_scores(calibration: Calibration, scores: DataFrame, column: str = "score") -> DataFrame:
    """A table's scores mapped through a calibration; null scores stay null."""
    p = F.col(column)
    if calibration.method == "temperature":
        return scores.withColumn(column, sigmoid(logit(p) / calibration.params["T"]))
    if calibration.method == "platt":
        a, b = calibration.params["a"], calibration.params["b"]
        return scores.withColumn(column, sigmoid(logit(p) * a + b))
    return _interpolated(calibration.knots, scores, column)


def calibrate(fit_rows: DataFrame, rows: DataFrame, method: str) -> tuple[DataFrame, Calibration]:
    """`rows` with its ok scores recalibrated by a map fitted on the ok rows of `fit_rows`.

    Unscored rows pass through; a logit column is cleared where the score changed.
    """
    found = fit(method, fit_rows.where(F.col("status") == "ok"))
    ok = F.col("status") == "ok"
    mapped = apply_scores(found, rows.withColumn("_p", F.when(ok, F.col("score"))), "_p")
    out = mapped.withColumn("score", F.when(ok, F.col("_p")).otherwise(F.col("score"))).drop("_p")
    if "logit" in out.columns:
        out = out.withColumn("logit", F.when(~ok, F.col("logit")))
    return out, found

