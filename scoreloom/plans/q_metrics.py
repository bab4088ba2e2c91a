"""Queries: coverage, clip-to-video reduction, exact metrics and their curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.scores import apply_missing_policy, row_problems
from scoreloom.operators import metrics as M
from scoreloom.operators.coverage import (
    cells_coverage,
    cells_hist,
    clip_to_video,
    coverage,
    status_cells,
)
from scoreloom.operators.ordered import midranks
from scoreloom.plans import views as V
from scoreloom.plans.catalog import query, r9
from scoreloom.plans.views import with_views

VIDEO = ["dataset", "key", "compression", "label"]
G = ["dataset"]


def ok_rows(spark: SparkSession, d: str) -> DataFrame:
    return apply_missing_policy(V.scores(spark, d))


@query(
    "entry_clip_to_auc",
    with_views(
        """
SELECT c.dataset, c.expected, c.ok, c.missing, round(c.ok / CAST(c.expected AS DOUBLE), 9) AS coverage,
  round(a.auc, 9) AS auc
FROM (SELECT dataset, count(*) AS expected, count(score) AS ok, count(*) - count(score) AS missing FROM vid GROUP BY dataset) c
JOIN (SELECT dataset, (sum(rk) FILTER (label = 1) - max(np) * (max(np) + 1) / 2.0) / (max(np) * (count(*) - max(np))) AS auc
      FROM (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0 AS rk,
              sum(label) OVER (PARTITION BY dataset) AS np FROM vid WHERE score IS NOT NULL) GROUP BY dataset) a
  ON a.dataset = c.dataset
""",
        "fx_clips",
        vid="""SELECT v.dataset, v.key, v.label, c.score FROM fx_videos v
  LEFT JOIN (SELECT key, avg(score) AS score FROM fx_clips GROUP BY key) c ON c.key = v.key""",
    ),
)
def entry_clip_to_auc(spark: SparkSession, d: str) -> DataFrame:
    per_video = clip_to_video(V.clips(spark, d), ["key"])
    rows = (
        V.videos(spark, d)
        .join(per_video, "key", "left")
        .withColumn("status", F.when(F.col("score").isNull(), "missing").otherwise("ok"))
    )
    cells = status_cells(rows, G)
    cov = cells_coverage(cells, G)
    auc = M.compute(None, G, {"auc": M.auc()}, hist=cells_hist(cells, G))
    return cov.join(auc, G).select(
        *G, "expected", "ok", "missing", r9("coverage").alias("coverage"), r9("auc").alias("auc")
    )


@query(
    "a01_coverage_counts",
    with_views(
        """SELECT dataset, count(*) AS expected, count(*) FILTER (status = 'ok') AS ok,
  count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'error') AS error
FROM fx_scores GROUP BY dataset""",
        "fx_scores",
    ),
)
def a01(spark: SparkSession, d: str) -> DataFrame:
    return coverage(V.scores(spark, d), G).drop("coverage")


@query(
    "a02_coverage_fraction",
    with_views(
        """SELECT dataset, label_key, round(count(*) FILTER (status = 'ok') / CAST(count(*) AS DOUBLE), 9) AS coverage,
  count(*) FILTER (status = 'ok') / CAST(count(*) AS DOUBLE) >= 0.94 AS meets
FROM fx_scores GROUP BY dataset, label_key""",
        "fx_scores",
    ),
)
def a02(spark: SparkSession, d: str) -> DataFrame:
    c = coverage(V.scores(spark, d), ["dataset", "label_key"], 0.94)
    return c.select("dataset", "label_key", r9("coverage").alias("coverage"), "meets")


_REDUCE = {
    "a03_mean_prob": ("mean-prob", "avg(score)"),
    "a04_mean_logit": (
        "mean-logit",
        "1 / (1 + exp(-avg(ln(least(greatest(score, 1e-7), 1 - 1e-7) / (1 - least(greatest(score, 1e-7), 1 - 1e-7))))))",
    ),
    "a05_max": ("max", "max(score)"),
    "a06_median": ("median", "quantile_cont(score, 0.5)"),
    "a07_vote": ("vote", "avg(CASE WHEN score >= 0.6 THEN 1.0 ELSE 0.0 END)"),
}


def _reduce(name: str, mode: str, sql: str) -> None:
    @query(
        name,
        with_views(
            f"SELECT dataset, key, compression, label, round({sql}, 9) AS score, count(*) AS n_clips"
            " FROM fx_clips GROUP BY ALL",
            "fx_clips",
        ),
    )
    def plan(spark: SparkSession, d: str) -> DataFrame:
        out = clip_to_video(V.clips(spark, d), VIDEO, mode, thr=0.6)
        return out.select(*VIDEO, r9("score").alias("score"), "n_clips")


for _name, (_mode, _sql) in _REDUCE.items():
    _reduce(_name, _mode, _sql)


_CROSS = """SELECT dataset, fpr, tpr, fpr0, tpr0, score, coalesce(lag(score) OVER (PARTITION BY dataset ORDER BY score DESC), score) AS s0,
  -(fpr0 - (1 - tpr0)) / ((fpr - (1 - tpr)) - (fpr0 - (1 - tpr0))) AS t,
  fpr - (1 - tpr) >= 0 AND fpr0 - (1 - tpr0) < 0 AS here FROM fx_rates"""

# metric name -> (spec, SQL over fx_rates / fx_hist / fx_ok giving dataset and value, views, ctes)
_METRICS: dict[str, tuple[M.Metric, str, list[str], dict[str, str]]] = {
    "a08_auc": (
        M.auc(),
        "SELECT dataset, sum(pos * (n_neg - cum_neg + 0.5::DOUBLE * neg)) / max(n_pos * n_neg) AS value FROM fx_rates GROUP BY dataset",
        ["fx_rates"], {},
    ),
    "a09_ap": (
        M.ap(),
        "SELECT dataset, sum(pos / CAST(n_pos AS DOUBLE) * (cum_pos / CAST(cum_pos + cum_neg AS DOUBLE))) AS value FROM fx_rates GROUP BY dataset",
        ["fx_rates"], {},
    ),
    "a11_eer": (
        M.eer(),
        "SELECT dataset, (fpr0 + t * (fpr - fpr0) + 1 - tpr0 + t * (tpr0 - tpr)) / 2 AS value FROM x WHERE here",
        ["fx_rates"], {"x": _CROSS},
    ),
    "a11_eer_threshold": (
        M.eer_threshold(),
        "SELECT dataset, s0 + t * (score - s0) AS value FROM x WHERE here",
        ["fx_rates"], {"x": _CROSS},
    ),
    "a12_accuracy": (
        M.acc(0.9),
        "SELECT dataset, avg(CASE WHEN (score >= 0.9) = (label = 1) THEN 1.0 ELSE 0.0 END) AS value FROM fx_ok GROUP BY dataset",
        ["fx_ok"], {},
    ),
    "a13_tpr_at_fpr": (
        M.tpr(fpr=0.05),
        "SELECT dataset, greatest(0.0, max(tpr) FILTER (fpr <= 0.05)) AS value FROM fx_rates GROUP BY dataset",
        ["fx_rates"], {},
    ),
    "a13_tpr_at_fpr_interp": (
        M.tpr(fpr=0.05, interp=True),
        "SELECT dataset, tpr0 + (tpr - tpr0) / (fpr - fpr0) * (0.05 - fpr0) AS value FROM fx_rates WHERE fpr0 <= 0.05 AND fpr > 0.05",
        ["fx_rates"], {},
    ),
    "a14_fpr_at_tpr": (
        M.fpr(tpr=0.9),
        "SELECT dataset, min(fpr) FILTER (tpr >= 0.9) AS value FROM fx_rates GROUP BY dataset",
        ["fx_rates"], {},
    ),
    "a14_fpr_at_tpr_interp": (
        M.fpr(tpr=0.9, interp=True),
        "SELECT dataset, fpr0 + (fpr - fpr0) / (tpr - tpr0) * (0.9 - tpr0) AS value FROM fx_rates WHERE tpr0 <= 0.9 AND tpr > 0.9",
        ["fx_rates"], {},
    ),
    "a17_brier": (
        M.brier(),
        "SELECT dataset, avg((score - label) * (score - label)) AS value FROM fx_ok GROUP BY dataset",
        ["fx_ok"], {},
    ),
    "a18_nll": (
        M.nll(),
        "SELECT dataset, -avg(CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END) AS value"
        " FROM (SELECT *, least(greatest(score, 1e-7), 1 - 1e-7) AS p FROM fx_ok) GROUP BY dataset",
        ["fx_ok"], {},
    ),
    "a15_ece": (
        M.ece(),
        "SELECT dataset, sum(n * abs(mp - my)) / sum(n) AS value FROM b GROUP BY dataset",
        ["fx_ok"],
        {
            "b": "SELECT dataset, len(list_filter(range(1, 15), lambda i: score >= i * (1.0::DOUBLE / 15))) AS bin,"
            " count(*) AS n, avg(score) AS mp, avg(label) AS my FROM fx_ok GROUP BY ALL"
        },
    ),
    "a16_ece_adaptive": (
        M.ece(adaptive=True),
        "SELECT dataset, sum(n * abs(mp - my)) / sum(n) AS value FROM b GROUP BY dataset",
        ["fx_ok"],
        {
            "e": "SELECT dataset, quantile_cont(score, [i / CAST(15 AS DOUBLE) for i in range(1, 15)]) AS edges FROM fx_ok GROUP BY dataset",
            "b": "SELECT o.dataset, len(list_filter(edges, lambda x: score >= x)) AS bin,"
            " count(*) AS n, avg(score) AS mp, avg(label) AS my FROM fx_ok o JOIN e ON e.dataset = o.dataset GROUP BY ALL",
        },
    ),
    "a19_aurc": (
        M.aurc(),
        "SELECT dataset, avg(e / k) AS value FROM rc GROUP BY dataset",
        ["fx_ok"],
        {
            "rc": "SELECT dataset, sum(CASE WHEN (score >= 0.5) = (label = 1) THEN 0.0::DOUBLE ELSE 1 END) OVER w AS e, row_number() OVER w AS k"
            " FROM fx_ok WINDOW w AS (PARTITION BY dataset ORDER BY greatest(score, 1 - score) DESC, key, coalesce(compression, '')"
            " ROWS UNBOUNDED PRECEDING)"
        },
    ),
}


def _metric(name: str, m: M.Metric, sql: str, views: list[str], ctes: dict[str, str]) -> None:
    @query(name, with_views(f"SELECT dataset, round(value, 9) AS value FROM ({sql})", *views, **ctes))
    def plan(spark: SparkSession, d: str) -> DataFrame:
        out = M.compute(ok_rows(spark, d), G, {"value": m})
        return out.select(*G, r9("value").alias("value"))


for _name, (_m, _sql, _views, _ctes) in _METRICS.items():
    _metric(_name, _m, _sql, _views, _ctes)


@query(
    "a10_roc_points",
    with_views(
        """SELECT dataset, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, score AS threshold FROM fx_rates
UNION ALL SELECT DISTINCT dataset, 0.0, 0.0, 'inf'::DOUBLE FROM fx_rates""",
        "fx_rates",
    ),
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    points = M.roc_points(M.score_hist(ok_rows(spark, d), G), G)
    return points.select(*G, r9("fpr").alias("fpr"), r9("tpr").alias("tpr"), "threshold")


@query(
    "a20_all_metrics_by_group",
    with_views(
        """SELECT f.dataset, f.label_key, max(f.np) AS n_pos, max(f.nn) AS n_neg,
  round(sum(pos * (nn - cn + 0.5::DOUBLE * neg)) / nullif(max(np * nn), 0), 9) AS auc,
  round(sum(pos * (score - 1) * (score - 1) + neg * score * score) / sum(pos + neg), 9) AS brier,
  round(sum(CASE WHEN score >= 0.5 THEN pos ELSE neg END) / CAST(sum(pos + neg) AS DOUBLE), 9) AS acc,
  CASE WHEN max(f.nn) = 0 THEN 'every label is fake' WHEN max(f.np) = 0 THEN 'every label is real' END AS undefined
FROM f GROUP BY ALL""",
        "fx_ok",
        h="SELECT dataset, label_key, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM fx_ok GROUP BY ALL",
        f="""SELECT *, CAST(sum(pos) OVER g AS BIGINT) AS np, CAST(sum(neg) OVER g AS BIGINT) AS nn,
  sum(neg) OVER (PARTITION BY dataset, label_key ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn
  FROM h WINDOW g AS (PARTITION BY dataset, label_key)""",
    ),
)
def a20(spark: SparkSession, d: str) -> DataFrame:
    by = ["dataset", "label_key"]
    wanted = {"auc": M.metric("auc"), "brier": M.metric("brier"), "acc": M.metric("acc", thr=0.5)}
    out = M.compute(ok_rows(spark, d), by, wanted)
    return out.select(
        *by, "n_pos", "n_neg", *[r9(k).alias(k) for k in wanted], "undefined"
    )


@query(
    "a44_reliability_curve",
    with_views(
        """SELECT dataset, CAST(len(list_filter(range(1, 15), lambda i: score >= i * (1.0::DOUBLE / 15))) AS INTEGER) AS bin,
  count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(label), 9) AS fake_share FROM fx_ok GROUP BY ALL""",
        "fx_ok",
    ),
)
def a44(spark: SparkSession, d: str) -> DataFrame:
    p = M.reliability(M.score_hist(ok_rows(spark, d), G), G)
    return p.select(
        *G, "bin", "n", r9("mean_score").alias("mean_score"), r9("fake_share").alias("fake_share")
    )


@query(
    "a45_risk_coverage_curve",
    with_views(
        """SELECT dataset, k, round(k / CAST(n AS DOUBLE), 9) AS coverage, round(e / k, 9) AS risk FROM rc""",
        "fx_ok",
        rc="""SELECT dataset, sum(CASE WHEN (score >= 0.5) = (label = 1) THEN 0.0::DOUBLE ELSE 1 END) OVER w AS e,
  row_number() OVER w AS k, count(*) OVER (PARTITION BY dataset) AS n
  FROM fx_ok WINDOW w AS (PARTITION BY dataset ORDER BY greatest(score, 1 - score) DESC, key, coalesce(compression, '')
  ROWS UNBOUNDED PRECEDING)""",
    ),
)
def a45(spark: SparkSession, d: str) -> DataFrame:
    p = M.risk_coverage(ok_rows(spark, d), G)
    return p.select(*G, "k", r9("coverage").alias("coverage"), r9("risk").alias("risk"))


@query(
    "a46_det_points",
    with_views(
        """SELECT dataset, round(greatest(fpr, 1e-4), 9) AS fpr, round(greatest(1 - tpr, 1e-4), 9) AS fnr FROM
  (SELECT dataset, fpr, tpr FROM fx_rates UNION ALL SELECT DISTINCT dataset, 0.0, 0.0 FROM fx_rates)""",
        "fx_rates",
    ),
)
def a46(spark: SparkSession, d: str) -> DataFrame:
    p = M.det_points(M.score_hist(ok_rows(spark, d), G), G)
    return p.select(*G, r9("fpr").alias("fpr"), r9("fnr").alias("fnr"))


@query(
    "w01_midranks",
    with_views(
        """SELECT dataset, score, count(*) AS n, any_value(mr) AS midrank FROM
  (SELECT dataset, score, rank() OVER (PARTITION BY dataset ORDER BY score) + (count(*) OVER (PARTITION BY dataset, score) - 1) / CAST(2 AS DOUBLE) AS mr FROM fx_ok)
  GROUP BY ALL""",
        "fx_ok",
    ),
)
def w01(spark: SparkSession, d: str) -> DataFrame:
    return midranks(ok_rows(spark, d), G, "score")


@query("w04_running_counts", with_views("SELECT dataset, score, cum_pos, cum_neg FROM fx_curve", "fx_curve"))
def w04(spark: SparkSession, d: str) -> DataFrame:
    curve = M.roc_curve(M.score_hist(ok_rows(spark, d), G), G)
    return curve.select(*G, "score", "cum_pos", "cum_neg")


@query(
    "p14_missing_policy",
    with_views(
        """SELECT dataset, policy, count(*) AS n, round(avg(score), 9) AS mean_score FROM
  (SELECT dataset, 'exclude' AS policy, score FROM fx_scores WHERE status = 'ok'
   UNION ALL SELECT dataset, 'as-real', CASE WHEN status = 'ok' THEN score ELSE 0.0 END FROM fx_scores
   UNION ALL SELECT dataset, 'as-fake', CASE WHEN status = 'ok' THEN score ELSE 1.0 END FROM fx_scores
   UNION ALL SELECT dataset, 'as-chance', CASE WHEN status = 'ok' THEN score ELSE 0.5 END FROM fx_scores) GROUP BY ALL""",
        "fx_scores",
    ),
)
def p14(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores(spark, d)
    out = None
    for policy in ("exclude", "as-real", "as-fake", "as-chance"):
        part = apply_missing_policy(rows, policy).groupBy(*G).agg(
            F.count(F.lit(1)).alias("n"), r9(F.avg("score")).alias("mean_score")
        ).withColumn("policy", F.lit(policy))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "d02_score_row_problems",
    with_views(
        """SELECT dataset, key, problem FROM (
  SELECT dataset, key, unnest([
    CASE WHEN label IS NULL THEN 'label is not an integer' END,
    CASE WHEN status NOT IN ('ok', 'missing', 'error') THEN 'unknown status' END,
    CASE WHEN status = 'ok' AND (score IS NULL OR score < 0 OR score > 1) THEN 'ok needs a score in [0, 1]' END,
    CASE WHEN status <> 'ok' AND score IS NOT NULL THEN 'only ok rows carry a score' END]) AS problem
  FROM (SELECT dataset, key, label, score * 1.05 AS score, CASE WHEN score > 0.93 THEN 'done' WHEN score > 0.92 THEN 'missing' ELSE status END AS status FROM fx_scores))
WHERE problem IS NOT NULL""",
        "fx_scores",
    ),
)
def d02(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    broken = V.scores(spark, d).select(
        "dataset",
        "key",
        "label",
        (s * 1.05).alias("score"),
        F.when(s > 0.93, "done").when(s > 0.92, "missing").otherwise(F.col("status")).alias("status"),
    )
    problems = F.explode(F.array_compact(F.array(*row_problems())))
    return broken.select("dataset", "key", problems.alias("problem"))


@query(
    "d03_duplicates_and_coverage",
    with_views(
        """SELECT dataset, sum(n) AS expected, sum(k) AS ok, count(*) FILTER (n > 1) AS repeated_keys FROM
  (SELECT dataset, key, compression, count(*)::BIGINT AS n, count(*) FILTER (score >= 0.5)::BIGINT AS k FROM fx_clips GROUP BY ALL) GROUP BY dataset""".replace("sum(n)", "CAST(sum(n) AS BIGINT)").replace("sum(k)", "CAST(sum(k) AS BIGINT)"),
        "fx_clips",
    ),
)
def d03(spark: SparkSession, d: str) -> DataFrame:
    from scoreloom.operators.checks import key_counts

    rows = V.clips(spark, d).withColumn("ok", F.col("score") >= 0.5)
    keyed = key_counts(rows, ["dataset", "key", "compression"], ok=F.count_if("ok"))
    return keyed.groupBy("dataset").agg(
        F.sum("n").alias("expected"),
        F.sum("ok").alias("ok"),
        F.count_if(F.col("n") > 1).alias("repeated_keys"),
    )


@query(
    "d04_metric_input_problems",
    with_views(
        """SELECT dataset, CAST(0 AS BIGINT) AS n_nan, count(*) FILTER (score > 0.9) AS n_inf,
  CAST(0 AS BIGINT) AS n_out_of_range, count(*) FILTER (score IS NULL) AS n_null, count(*) FILTER (label_key = 'FAKE_B') AS n_bad_label,
  count(*) FILTER (label_key = 'FAKE_A') AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM fx_scores GROUP BY dataset""",
        "fx_scores",
    ),
)
def d04(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("score")
    broken = V.scores(spark, d).select(
        "dataset",
        F.when(s > 0.9, F.lit(float("inf"))).otherwise(s).alias("score"),
        F.when(F.col("label_key") == "FAKE_B", 2).otherwise(F.col("label")).alias("label"),
    )
    return M.input_problems(broken, G)


@query(
    "f01_registered_metric",
    with_views(
        "SELECT dataset, round(avg(abs(score - label)), 9) AS value FROM fx_ok GROUP BY dataset", "fx_ok"
    ),
)
def f01(spark: SparkSession, d: str) -> DataFrame:
    if "mean_gap" not in M.REGISTRY:
        s = F.col("score")
        M.register(
            "mean_gap",
            lambda: F.sum(F.col("pos") * (1.0 - s) + F.col("neg") * s) / F.sum(F.col("pos") + F.col("neg")),
        )
    out = M.compute(ok_rows(spark, d), G, {"value": M.metric("mean_gap")})
    return out.select(*G, r9("value").alias("value"))
