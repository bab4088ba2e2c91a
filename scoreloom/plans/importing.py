"""Importing foreign score tables against a split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.scores import STATUSES, compose_key, import_score, import_status
from scoreloom.operators.joins import ROW_KEY, double_matched, match_import, missing_rows


def import_scores(
    foreign: DataFrame,
    split_videos: DataFrame,
    mapping: DataFrame,
    *,
    key: str,
    score: str,
    line: str,
    label: str | None = None,
    compression: str | None = None,
    polarity: str = "fake-high",
    status: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A score table of the whole split from foreign rows, and everything wrong with them.

    Every split video is in the result, missing where no row names it; videos the mapping excludes
    are left out. The second table lists (problem, line, key): rows that match no video or share
    one, labels that disagree, scores that are no number in [0, 1], unknown statuses. An import is
    good when it is empty.
    """
    named = foreign.select(
        F.col(line).cast("long").alias("line"),
        compose_key(key, foreign.columns).alias("import_key"),
        (F.nullif(F.col(compression), F.lit("")) if compression else F.lit(None).cast("string")).alias(
            "import_compression"
        ),
        F.col(score).cast("string").alias("_score"),
        (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("_label"),
        (F.col(status) if status else F.lit("ok")).cast("string").alias("_status"),
    )
    labelled = split_videos.join(mapping, "label_key").where(F.col("mapped") != "exclude")
    matched, unmatched = match_import(named, split_videos, use_compression=compression is not None)
    kept = matched.join(mapping, "label_key").where(F.col("mapped") != "exclude")
    state = import_status(F.col("_status"))
    value = import_score(F.col("_score"), polarity)
    ok = state == "ok"
    rows = kept.select(
        *ROW_KEY,
        F.col("mapped").cast("int").alias("label"),
        F.when(ok, value).alias("score"),
        state.alias("status"),
        "label_key",
        "method",
        "line",
        "_label",
    )
    missing = missing_rows(labelled.drop("mapped"), rows, mapping)
    table = rows.drop("line", "_label").unionByName(missing)

    def problem(found: DataFrame, text: str, where: str = "key") -> DataFrame:
        return found.select(F.lit(text).alias("problem"), "line", F.col(where).alias("key"))

    p = F.col("score")
    checks = [
        problem(unmatched, "matches no video", "import_key"),
        problem(
            double_matched(matched).withColumn("line", F.col("last_line")), "names a video twice"
        ),
        problem(rows.where(~F.col("status").isin(*STATUSES)), "unknown status"),
        problem(
            rows.where((F.col("status") == "ok") & ~F.coalesce(p.between(0.0, 1.0), F.lit(False))),
            "score is no number in [0, 1]",
        ),
    ]
    if label:
        said = F.col("_label").try_cast("double").try_cast("int")
        checks.append(problem(rows.where(~said.eqNullSafe(F.col("label"))), "label disagrees"))
    return table, reduce(DataFrame.unionByName, checks)
