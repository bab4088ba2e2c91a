"""The evaluation report over many score tables at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError
from scoreloom.operators import bootstrap as B
from scoreloom.operators import metrics as M
from scoreloom.operators.coverage import cells_coverage, cells_hist, status_cells
from scoreloom.operators.joins import first_match
from scoreloom.functions.scores import apply_missing_policy
from scoreloom.operators.ordered import join_null_safe

DIMENSIONS = ("method", "compression", "label_key", "family")
Spec = tuple[str, dict]


def with_group(rows: DataFrame, by: str, vocab: DataFrame | None = None) -> DataFrame:
    """Rows with their breakdown group, null where a row has no value for it."""
    if by not in DIMENSIONS:
        raise ConfigError(f"unknown breakdown {by!r}; known: {', '.join(DIMENSIONS)}")
    if by == "family":
        if vocab is None:
            raise ConfigError("a breakdown by family needs the label vocabulary")
        rows = rows.join(vocab.select("label_key", "family"), "label_key", "left")
    return rows.withColumn("group", F.col(by).cast("string"))


def pooled_cells(rows: DataFrame, by: str, vocab: DataFrame | None = None) -> DataFrame:
    """Cells per (file, group), all-fake groups pooled with the reals of their datasets.

    A group of one method's fakes is measured against every real of its datasets in the file. The
    reals' cells are added to each such group's, so what multiplies with the number of groups is a
    histogram, never rows. A breakdown by compression stays a plain partition. Rows without a value
    for the dimension form no group but stay in the pool.
    """
    keys = ["file", "group"]
    cells = status_cells(with_group(rows, by, vocab), [*keys, "dataset"])
    named = cells.where(F.col("group").isNotNull())
    own = named.select(*keys, "status", "label", "score", "n")
    if by == "compression":
        return own
    sides = named.groupBy(*keys, "dataset").agg(F.min("label").alias("_least"))
    # one row per group and dataset
    whole = Window.partitionBy(*keys)
    links = (
        sides.withColumn("_least", F.min("_least").over(whole))
        .where(F.col("_least") == 1)
        .select(*keys, "dataset")
    )
    pool = (
        cells.where(F.col("label") == 0)
        .groupBy("file", "dataset", "status", "label", "score")
        .agg(F.sum("n").alias("n"))
    )
    return own.unionByName(links.join(pool, ["file", "dataset"]).drop("dataset"))


def pooled_groups(
    rows: DataFrame, by: str, *, missing: str = "exclude", vocab: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Histogram and coverage per (file, group) of `pooled_cells`."""
    cells = pooled_cells(rows, by, vocab)
    keys = ["file", "group"]
    return cells_hist(cells, keys, missing), cells_coverage(cells, keys)


def pooled_rows(rows: DataFrame, by: str, vocab: DataFrame | None = None) -> DataFrame:
    """The rows behind `pooled_cells`, for metrics that depend on the order of rows.

    Reals are repeated for every group of fakes that is measured against them.
    """
    keys = ["file", "group"]
    named = with_group(rows, by, vocab)
    own = named.where(F.col("group").isNotNull())
    if by == "compression":
        return own
    sides = own.groupBy(*keys, "dataset").agg(F.min("label").alias("_least"))
    links = (
        sides.withColumn("_least", F.min("_least").over(Window.partitionBy(*keys)))
        .where(F.col("_least") == 1)
        .select(*keys, "dataset")
    )
    pool = named.where(F.col("label") == 0).drop("group")
    return own.unionByName(links.join(pool, ["file", "dataset"]), allowMissingColumns=True)


def _long(
    hist: DataFrame, keys: Sequence[str], metrics: dict[str, Spec], n_boot: int, seed: int, rows: DataFrame
) -> DataFrame:
    """(keys, metric, value, ci_lo, ci_hi, undefined), one row per metric.

    Values are those of the rows as they stand; only `aurc` reads them again, for the order of ties.
    """
    parts = []
    if n_boot:
        for label, (name, params) in metrics.items():
            part = B.bootstrap_ci(hist, keys, name, params, n_boot=n_boot, seed=seed, rows=rows)
            parts.append(part.withColumn("metric", F.lit(label)))
    else:
        # every metric of the report comes from one plan over the shared histogram
        wide = M.compute(
            rows, keys, {k: M.metric(n, **p) for k, (n, p) in metrics.items()}, hist=hist
        )
        cells = [F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("value")) for k in metrics]
        none = F.lit(None).cast("double")
        parts.append(
            wide.select(*keys, "undefined", F.explode(F.array(*cells)).alias("_m")).select(
                *keys,
                "_m.metric",
                "_m.value",
                none.alias("ci_lo"),
                none.alias("ci_hi"),
                "undefined",
            )
        )
    table = reduce(DataFrame.unionByName, parts)
    return table.withColumn("undefined", F.when(F.col("value").isNull(), F.col("undefined")))


def seed_table(points: DataFrame, files: DataFrame) -> DataFrame:
    """Mean and deviation per metric over files of one run that differ only in seed.

    `files` has file, file_index, seed and `identity`, the text all seeds of a run share. Of two
    files with one seed the first counts; a metric needs two seeds with a value.
    """
    first = Window.partitionBy("identity", "seed").orderBy("file_index")
    kept = (
        files.where(F.col("seed").isNotNull())
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") == 1)
        .select("file", "identity", "seed")
    )
    defined = points.where(F.col("value").isNotNull()).join(kept, "file")
    out = B.seed_summary(defined.select("identity", "metric", "seed", "value"), ["identity", "metric"])
    return out.where(F.col("n_seeds") >= 2)


def run_identity(columns: Sequence[str]) -> Column:
    """One text of everything that makes two files the same run but for the seed."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def suite_table(
    entries: DataFrame, aggregates: DataFrame, files: DataFrame, points: DataFrame
) -> DataFrame:
    """The mean of a metric over a suite group's entries, with how many counted and were expected.

    `entries`: (entry, group, protocol, split, where_key); `aggregates`: (group, metric).
    """
    matched = first_match(entries, files).join(files.select("file_index", "file"), "file_index", "left")
    expected = entries.groupBy("group").agg(F.count(F.lit(1)).alias("n_expected"))
    asked = aggregates.join(matched.select("group", "file"), "group")
    values = points.select("file", "metric", "value")
    found = join_null_safe(asked, values, ["file", "metric"], "left")
    rows = found.groupBy("group", "metric").agg(
        F.avg("value").alias("value"), F.count("value").alias("n_entries")
    )
    reason = F.when(F.col("n_entries") == 0, F.lit("undefined for every scored entry"))
    return rows.join(expected, "group").withColumn("undefined", reason)


def evaluate(
    rows: DataFrame,
    metrics: dict[str, Spec],
    *,
    by: str | None = None,
    vocab: DataFrame | None = None,
    files: DataFrame | None = None,
    suite: tuple[DataFrame, DataFrame] | None = None,
    n_boot: int = 2000,
    seed: int = 0,
    missing: str = "exclude",
    min_coverage: float = 0.99,
) -> dict[str, DataFrame]:
    """Report tables over score rows with a `file` column.

    `files`: coverage and metrics per file; `breakdown` when `by` is given; `seeds` and `suite`
    when the file table or a suite is given; `status`: one row with exit_code 3 when any file is
    covered less than `min_coverage`.
    """
    keys = ["file"]
    cells = status_cells(rows, keys)
    cover = cells_coverage(cells, keys, min_coverage)
    hist = cells_hist(cells, keys, missing)
    points = _long(hist, keys, metrics, n_boot, seed, apply_missing_policy(rows, missing))
    n = hist.groupBy(*keys).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"))
    per_file = cover.join(n, "file", "left").join(points, "file", "left")
    out = {
        "files": per_file.withColumn("n", F.coalesce("n", F.lit(0))),
        "status": cover.agg(
            F.when(F.bool_and("meets"), 0).otherwise(3).alias("exit_code")
        ),
    }
    if by is not None:
        keys = ["file", "group"]
        group_hist, covered = pooled_groups(rows, by, missing=missing, vocab=vocab)
        pooled = apply_missing_policy(pooled_rows(rows, by, vocab), missing)
        table = _long(group_hist, keys, metrics, n_boot, seed, pooled).where(F.col("value").isNotNull())
        out["breakdown"] = covered.join(table.drop("undefined"), keys, "left")
    if files is not None:
        out["seeds"] = seed_table(points, files)
        if suite is not None:
            out["suite"] = suite_table(*suite, files, points)
    return out


def metric_map(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with a map from metric to its value, interval and reason."""
    cell = F.struct("value", "ci_lo", "ci_hi", "undefined")
    pairs = F.array_sort(F.collect_list(F.struct(F.col("metric"), cell.alias("cell"))))
    grouped = table.groupBy(*keys).agg(pairs.alias("_m"))
    return grouped.select(*keys, F.map_from_entries("_m").alias("metrics"))


def validation_means(
    clips: DataFrame, metrics: dict[str, Spec], *, source: str, keys: Sequence[str]
) -> dict[str, DataFrame]:
    """Metrics per validation source on video scores, their mean over sources, and the loss.

    A source where a metric is undefined is left out of that metric's mean; the loss is weighted by
    clips.
    """
    videos = clips.groupBy(source, *keys).agg(F.avg("score").alias("score"), F.max("label").alias("label"))
    points = _long(M.score_hist(videos, [source]), [source], metrics, 0, 0, videos)
    means = points.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.count("value").alias("n_sources")
    )
    loss = clips.agg((F.sum("loss") / F.count("loss")).alias("loss"))
    return {"sources": points, "means": means, "loss": loss}
