"""Queries: reports, breakdowns, seeds, suites, comparison, intervals and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import scores as X
from scoreloom.operators import bootstrap as B
from scoreloom.operators import calibrate as CAL
from scoreloom.operators import compare as CMP
from scoreloom.operators import metrics as M
from scoreloom.plans import report as REP
from scoreloom.plans import views as V
from scoreloom.plans.catalog import query, r9
from scoreloom.plans.q_keys import VOCAB_SQL, vocab
from scoreloom.plans.views import with_views

# score files: the two scorers, each in three slices standing for the datasets
FILES = """SELECT 'a-' || dataset AS file, dataset, key, compression, label, label_key, method, score, status FROM fx_scores
UNION ALL SELECT 'b-' || dataset, dataset, key, compression, label, label_key, method, score_b, status_b FROM fx_scores"""
AUC = """SELECT {by}, sum(pos * (nn - cn + 0.5::DOUBLE * neg)) / nullif(max(np * nn), 0) AS auc,
  sum(pos * (score - 1) * (score - 1) + neg * score * score) / sum(pos + neg) AS brier FROM (
  SELECT *, CAST(sum(pos) OVER (PARTITION BY {by}) AS BIGINT) AS np, CAST(sum(neg) OVER (PARTITION BY {by}) AS BIGINT) AS nn,
  sum(neg) OVER (PARTITION BY {by} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn FROM (
  SELECT {by}, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM {src} WHERE status = 'ok' GROUP BY ALL)) GROUP BY {by}"""
SPECS = {"auc": ("auc", {}), "brier": ("brier", {})}


def per_scorer(rows: DataFrame, files: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """One row per video and scorer from a table that holds the scorers side by side."""
    cols = ["dataset", "key", "compression", "label", "label_key", "method"]
    each = [
        F.struct(f.alias("file"), s.alias("score"), t.alias("status")) for f, s, t in files.values()
    ]
    return rows.select(*cols, F.explode(F.array(*each)).alias("_f")).select(
        "_f.file", *cols, "_f.score", "_f.status"
    )


def files(spark: SparkSession, d: str) -> DataFrame:
    """Score rows of six files: two scorers over three datasets."""
    name = lambda x: F.concat(F.lit(f"{x}-"), "dataset")
    return per_scorer(
        V.scores(spark, d),
        {
            "a": (name("a"), F.col("score"), F.col("status")),
            "b": (name("b"), F.col("score_b"), F.col("status_b")),
        },
    )


@query(
    "a27_evaluate_files",
    with_views(
        """SELECT c.file, c.n AS expected, c.ok, c.missing, c.error, round(c.ok / CAST(c.n AS DOUBLE), 9) AS coverage, m.metric, round(m.value, 9) AS value
FROM (SELECT file, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'error') AS error FROM f GROUP BY file) c
JOIN (SELECT file, 'auc' AS metric, auc AS value FROM u UNION ALL SELECT file, 'brier', brier FROM u) m USING (file)""",
        "fx_scores", f=FILES, u=AUC.format(by="file", src="f"),
    ),
)
def a27(spark: SparkSession, d: str) -> DataFrame:
    out = REP.evaluate(files(spark, d), SPECS, n_boot=0)["files"]
    return out.select(
        "file", "expected", "ok", "missing", "error", r9("coverage").alias("coverage"), "metric", r9("value").alias("value")
    )


_GROUPS = """SELECT file, dataset, {dim} AS grp, label, score, status FROM f WHERE {dim} IS NOT NULL"""
_POOLED = """SELECT file, grp, label, score, status FROM g UNION ALL
SELECT g.file, g.grp, r.label, r.score, r.status FROM (SELECT DISTINCT file, grp, dataset FROM g WHERE (file, grp) IN (SELECT (file, grp) FROM g GROUP BY file, grp HAVING min(label) = 1)) g
JOIN f r ON r.file = g.file AND r.dataset = g.dataset AND r.label = 0"""


def _breakdown(name: str, by: str, groups: str, rows: str) -> None:
    @query(
        name,
        with_views(
            """SELECT c.file, c.grp AS "group", c.n AS expected, c.ok, m.metric, round(m.value, 9) AS value
FROM (SELECT file, grp, count(*) AS n, count(*) FILTER (status = 'ok') AS ok FROM e GROUP BY ALL) c
LEFT JOIN (SELECT file, grp, 'auc' AS metric, auc AS value FROM u WHERE auc IS NOT NULL UNION ALL SELECT file, grp, 'brier', brier FROM u) m USING (file, grp)""",
            "fx_scores", f=FILES, v=VOCAB_SQL, g=groups, e=rows, u=AUC.format(by="file, grp", src="e"),
        ),
    )
    def plan(spark: SparkSession, d: str) -> DataFrame:
        out = REP.evaluate(files(spark, d), SPECS, by=by, vocab=vocab(spark, d), n_boot=0)
        return out["breakdown"].select(
            "file", "group", "expected", "ok", "metric", r9("value").alias("value")
        )


_breakdown("a25_breakdown_by_method", "method", _GROUPS.format(dim="method"), _POOLED)
_breakdown("a25_breakdown_by_compression", "compression", _GROUPS.format(dim="compression"), "SELECT * FROM g")
_breakdown(
    "a25_breakdown_by_family", "family",
    "SELECT file, dataset, family AS grp, label, score, status FROM f JOIN v USING (label_key)", _POOLED,
)


@query(
    "j14_pooled_histogram",
    with_views(
        """SELECT file, grp AS "group", score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM e WHERE status = 'ok' GROUP BY ALL""",
        "fx_scores", f=FILES, g=_GROUPS.format(dim="label_key"), e=_POOLED,
    ),
)
def j14(spark: SparkSession, d: str) -> DataFrame:
    return REP.pooled_groups(files(spark, d), "label_key")[0]


def file_table(spark: SparkSession, d: str) -> DataFrame:
    """One row per score file: its run, seed and place, read off the rows."""
    rows = files(spark, d).select("file", "dataset").distinct()
    scorer, n = F.substring("file", 1, 1), F.substring("dataset", 3, 1).cast("int")
    return rows.select(
        "file",
        (n * 2 + F.when(scorer == "b", 1).otherwise(0)).alias("file_index"),
        F.concat(F.lit("bench:"), "dataset").alias("protocol"),
        F.when(scorer == "a", "test").otherwise("val").alias("split"),
        F.lit("[]").alias("where_key"),
        (n % 2).alias("seed"),
        scorer.alias("identity"),
    )


@query(
    "a23_seed_mean_and_sd",
    with_views(
        """SELECT substr(dataset, 3, 1) AS ds, label_key, round(avg(m), 9) AS mean, round(coalesce(stddev_samp(m), 0), 9) AS sd, count(*) AS n_seeds FROM (
SELECT dataset, label_key, coalesce(compression, '_') AS c, avg(score) AS m FROM fx_ok GROUP BY ALL) GROUP BY ALL""",
        "fx_ok",
    ),
)
def a23(spark: SparkSession, d: str) -> DataFrame:
    ok = X.apply_missing_policy(V.scores(spark, d))
    per = ok.groupBy(
        F.substring("dataset", 3, 1).alias("ds"), "label_key", F.coalesce("compression", F.lit("_")).alias("seed")
    ).agg(F.avg("score").alias("value"))
    out = B.seed_summary(per, ["ds", "label_key"])
    return out.select("ds", "label_key", r9("mean").alias("mean"), r9("sd").alias("sd"), "n_seeds")


@query(
    "a24_seed_table",
    with_views(
        """SELECT substr(file, 1, 1) AS identity, metric, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd, count(*) AS n_seeds
FROM (SELECT file, 'auc' AS metric, auc AS value FROM u UNION ALL SELECT file, 'brier', brier FROM u) WHERE file NOT LIKE '%ds2' GROUP BY ALL""",
        "fx_scores", f=FILES, u=AUC.format(by="file", src="f"),
    ),
)
def a24(spark: SparkSession, d: str) -> DataFrame:
    # ds0 and ds2 share a seed: the first file of the two counts
    out = REP.evaluate(files(spark, d), SPECS, files=file_table(spark, d), n_boot=0)["seeds"]
    return out.select("identity", "metric", r9("mean").alias("mean"), r9("sd").alias("sd"), "n_seeds")


@query(
    "a26_suite_means",
    with_views(
        """SELECT g AS "group", 'auc' AS metric, round(avg(auc), 9) AS value, count(auc) AS n_entries, count(*) AS n_expected,
  CASE WHEN count(auc) = 0 THEN 'undefined for every scored entry' END AS undefined FROM (
SELECT p.dataset, s.g, CASE s.g WHEN 'in-domain' THEN 'a-' || dataset WHEN 'cross' THEN 'b-' || dataset END AS file FROM (SELECT DISTINCT dataset FROM fx_scores) p, (VALUES ('in-domain'), ('cross'), ('unscored')) AS s(g)) e
LEFT JOIN u ON u.file = e.file GROUP BY ALL""",
        "fx_scores", f=FILES, u=AUC.format(by="file", src="f"),
    ),
)
def a26(spark: SparkSession, d: str) -> DataFrame:
    table = file_table(spark, d)
    groups = F.explode(F.array(*[F.lit(g) for g in ("in-domain", "cross", "unscored")]))
    group = F.col("group")
    entries = table.select("protocol", "where_key").distinct().withColumn("group", groups).select(
        "protocol", "where_key", "group",
        F.when(group == "in-domain", "test").when(group == "cross", "val").otherwise("train").alias("split"),
    )
    wanted = entries.select("group").distinct().withColumn("metric", F.lit("auc"))
    out = REP.evaluate(files(spark, d), SPECS, files=table, suite=(entries, wanted), n_boot=0)["suite"]
    return out.select("group", "metric", r9("value").alias("value"), "n_entries", "n_expected", "undefined")


@query(
    "a28_validation_means",
    with_views(
        """SELECT 'auc' AS metric, round(avg(auc), 9) AS mean, count(auc) AS n_sources FROM u UNION ALL SELECT 'brier', round(avg(brier), 9), count(brier) FROM u""",
        "fx_clips",
        f="SELECT dataset, key, max(label) AS label, avg(score) AS score, 'ok' AS status FROM fx_clips GROUP BY dataset, key",
        u=AUC.format(by="dataset", src="f"),
    ),
)
def a28(spark: SparkSession, d: str) -> DataFrame:
    clips = V.clips(spark, d).withColumn("loss", F.lit(0.0))
    out = REP.validation_means(clips, SPECS, source="dataset", keys=["key"])["means"]
    return out.select("metric", r9("mean").alias("mean"), "n_sources")


@query(
    "a28_validation_loss",
    with_views(
        """SELECT round(avg(CASE WHEN label = 1 THEN ln(1 + exp(-z)) ELSE ln(1 + exp(z)) END), 9) AS loss FROM (
SELECT label, ln(p / (1 - p)) AS z FROM (SELECT label, least(greatest(score, 1e-6), 1 - 1e-6) AS p FROM fx_clips))""",
        "fx_clips",
    ),
)
def a28_loss(spark: SparkSession, d: str) -> DataFrame:
    clips = V.clips(spark, d)
    clips = clips.withColumn("loss", X.bce_loss(X.logit(F.col("score")), F.col("label")))
    out = REP.validation_means(clips, SPECS, source="dataset", keys=["key"])["loss"]
    return out.select(r9("loss").alias("loss"))


@query(
    "t16_losses",
    with_views(
        """SELECT dataset, round(avg(CASE WHEN label = 1 THEN 2 * ln(1 + exp(-z)) ELSE ln(1 + exp(z)) END), 9) AS bce,
  round(avg((CASE WHEN label = 1 THEN 0.25 ELSE 0.75 END) * pow(1 - CASE WHEN label = 1 THEN q ELSE 1 - q END, 2) * CASE WHEN label = 1 THEN ln(1 + exp(-z)) ELSE ln(1 + exp(z)) END), 9) AS focal,
  round(avg((label * 0.9 + 0.05) * ln(1 + exp(-z)) + (1 - label * 0.9 - 0.05) * ln(1 + exp(z))), 9) AS smoothed
FROM (SELECT *, 1 / (1 + exp(-z)) AS q FROM (SELECT dataset, label, ln(p / (1 - p)) AS z FROM (SELECT *, least(greatest(score, 1e-6), 1 - 1e-6) AS p FROM fx_clips))) GROUP BY dataset""",
        "fx_clips",
    ),
)
def t16(spark: SparkSession, d: str) -> DataFrame:
    z, y = X.logit(F.col("score")), F.col("label")
    return V.clips(spark, d).groupBy("dataset").agg(
        r9(F.avg(X.bce_loss(z, y, 2.0))).alias("bce"),
        r9(F.avg(X.focal_loss(z, y, 2.0, 0.25))).alias("focal"),
        r9(F.avg(X.smoothed_bce_loss(z, y, 0.1))).alias("smoothed"),
    )


def scorer_files(spark: SparkSession, d: str) -> DataFrame:
    both = (F.col("status") == "ok") & (F.col("status_b") == "ok")
    mean = (F.col("score") + F.col("score_b")) / 2
    return per_scorer(
        V.scores(spark, d),
        {
            "a": (F.lit("a"), F.col("score"), F.col("status")),
            "b": (F.lit("b"), F.col("score_b"), F.col("status_b")),
            "c": (F.lit("c"), F.when(both, mean), F.when(both, "ok").otherwise("error")),
        },
    )


@query(
    "a37_delong",
    with_views(
        """SELECT n_pos, n_neg, auc_a, auc_b, round(z, 6) AS z,
  round(1 - 2 / sqrt(2 * pi()) * abs(z) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(z * i / 2000) * (z * i / 2000) / 2))), 6) AS p
FROM (SELECT CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(1 - label) AS BIGINT) AS n_neg,
  round(avg(xa) FILTER (label = 1), 9) AS auc_a, round(avg(xb) FILTER (label = 1), 9) AS auc_b,
  round((avg(xa) FILTER (label = 1) - avg(xb) FILTER (label = 1)) / sqrt(var_samp(xa - xb) FILTER (label = 1) / sum(label) + var_samp(ya - yb) FILTER (label = 0) / sum(1 - label)), 15) AS z
FROM (SELECT label,
  (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE - (rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0::DOUBLE)) / (SELECT count(*) FROM s WHERE label = 0) AS xa,
  (rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / 2.0::DOUBLE - (rank() OVER (PARTITION BY label ORDER BY score_b) + (count(*) OVER (PARTITION BY label, score_b) - 1) / 2.0::DOUBLE)) / (SELECT count(*) FROM s WHERE label = 0) AS xb,
  1 - (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE - (rank() OVER (PARTITION BY label ORDER BY score) + (count(*) OVER (PARTITION BY label, score) - 1) / 2.0::DOUBLE)) / (SELECT count(*) FROM s WHERE label = 1) AS ya,
  1 - (rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / 2.0::DOUBLE - (rank() OVER (PARTITION BY label ORDER BY score_b) + (count(*) OVER (PARTITION BY label, score_b) - 1) / 2.0::DOUBLE)) / (SELECT count(*) FROM s WHERE label = 1) AS yb
  FROM s))""",
        "fx_scores",
        s="SELECT * FROM fx_scores WHERE status = 'ok' AND status_b = 'ok'",
    ),
)
def a37(spark: SparkSession, d: str) -> DataFrame:
    pairs = CMP.file_pairs(scorer_files(spark, d).where(F.col("file").isin("a", "b")))
    out = CMP.with_p_value(CMP.delong(CMP.joint_hist(pairs, ["a", "b"]), ["a", "b"]))
    return out.select(
        "n_pos", "n_neg", r9("auc_a").alias("auc_a"), r9("auc_b").alias("auc_b"),
        (F.round("z", 6) + 0.0).alias("z"), F.round("p", 6).alias("p"),
    )


@query(
    "a39_holm",
    with_views(
        """SELECT i, round(least(1.0, max((m - rk + 1) * p) OVER (ORDER BY p, i ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM (
SELECT i, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, i) AS rk FROM (SELECT c_custkey AS i, (c_custkey * 7919 % 1000) / 400000.0::DOUBLE AS p FROM customer))"""
    ).replace("WITH \n", ""),
)
def a39(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    tests = V.table(spark, d, "customer").select(
        c.alias("i"), ((c * 7919 % 1000) / F.lit(400000.0)).alias("p"), F.lit(0).alias("family")
    )
    out = CMP.holm(tests, ["family"])
    return out.select("i", r9("p_holm").alias("p_holm"))


@query(
    "a37_compare_files",
    with_views(
        """SELECT x.file AS a, y.file AS b, count(*) AS n, max(x.ok) - count(*) AS only_a, max(y.ok) - count(*) AS only_b,
  round(avg((y.score - y.label) * (y.score - y.label)) - avg((x.score - x.label) * (x.score - x.label)), 9) AS delta
FROM o x JOIN o y ON x.dataset = y.dataset AND x.key = y.key AND x.compression IS NOT DISTINCT FROM y.compression AND x.file < y.file GROUP BY ALL""",
        "fx_scores",
        o="""SELECT *, count(*) OVER (PARTITION BY file) AS ok FROM (
SELECT 'a' AS file, dataset, key, compression, label, score FROM fx_scores WHERE status = 'ok' UNION ALL
SELECT 'b', dataset, key, compression, label, score_b FROM fx_scores WHERE status_b = 'ok' UNION ALL
SELECT 'c', dataset, key, compression, label, (score + score_b) / 2 FROM fx_scores WHERE status = 'ok' AND status_b = 'ok')""",
    ),
)
def a37_compare(spark: SparkSession, d: str) -> DataFrame:
    out = CMP.compare(scorer_files(spark, d), {"brier": ("brier", {})}, n_boot=0)
    both = out["overlap"].join(out["metrics"], ["a", "b"])
    return both.select("a", "b", "n", "only_a", "only_b", r9("delta").alias("delta"))


# Random draws: the law is checked by property tests.
@query("a21_auc_bootstrap_ci")
def a21(spark: SparkSession, d: str) -> DataFrame:
    hist = M.score_hist(X.apply_missing_policy(V.scores(spark, d)), ["dataset"])
    return B.bootstrap_ci(hist, ["dataset"], "auc", n_boot=2000, seed=0)


@query("a38_paired_delta_ci")
def a38(spark: SparkSession, d: str) -> DataFrame:
    pairs = CMP.file_pairs(scorer_files(spark, d).where(F.col("file").isin("a", "b")))
    return CMP.paired_delta_ci(CMP.joint_hist(pairs, ["a", "b"]), ["a", "b"], "auc", n_boot=500)


def _pick(text: str, n: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT % {n}"


@query(
    "a22_stratified_resample",
    with_views(
        f"""SELECT rep, s.label, s.rn AS slot, t.key, t.compression FROM (SELECT r.*, q.rep FROM r, (VALUES (0), (1)) AS q(rep)) s
JOIN r t ON t.label = s.label AND t.rn = {_pick("'5:' || s.rep || ':' || s.label || ':' || s.rn", "s.cnt")} + 1""",
        "fx_videos",
        r="SELECT *, row_number() OVER (PARTITION BY label ORDER BY key) AS rn, count(*) OVER (PARTITION BY label) AS cnt FROM fx_videos",
    ),
)
def a22(spark: SparkSession, d: str) -> DataFrame:
    out = B.stratified_resample(V.videos(spark, d), ["key"], n_reps=2, seed=5)
    return out.select("rep", "label", "slot", "key", "compression")


# Iterative fits: checked against direct fits in the tests.
@query("a40_temperature_fit")
def a40(spark: SparkSession, d: str) -> DataFrame:
    found = CAL.fit("temperature", X.apply_missing_policy(V.scores(spark, d)))
    return spark.createDataFrame([(found.method, found.params["T"])], "method string, t double")


@query("a41_platt_fit")
def a41(spark: SparkSession, d: str) -> DataFrame:
    found = CAL.fit("platt", X.apply_missing_policy(V.scores(spark, d)))
    return spark.createDataFrame(
        [(found.method, found.params["a"], found.params["b"])], "method string, a double, b double"
    )


def _isotonic(src: str) -> dict[str, str]:
    """Knots of the isotonic fit: the greatest over starts of the least mean over ends, for every score."""
    return {
        "cells": f"SELECT row_number() OVER (ORDER BY score) AS i, score, sum(label) AS pos, count(*) AS n FROM {src} GROUP BY score",
        "pre": "SELECT i, score, pos, n, sum(pos) OVER (ORDER BY i) AS p1, sum(n) OVER (ORDER BY i) AS n1 FROM cells",
        "means": "SELECT a.i AS j, b.i AS i, (b.p1 - a.p1 + a.pos) / CAST(b.n1 - a.n1 + a.n AS DOUBLE) AS mean FROM pre a JOIN pre b ON b.i >= a.i",
        "least": "SELECT j, i, min(mean) OVER (PARTITION BY j ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS v FROM means",
        "fitted": "SELECT i, max(v) AS y FROM least GROUP BY i",
        "spans": "SELECT y, min(score) AS lo, max(score) AS hi FROM fitted JOIN cells USING (i) GROUP BY y",
        "knots": "SELECT lo AS x, y FROM spans UNION SELECT hi, y FROM spans",
    }


@query("a42_isotonic_fit", with_views("SELECT x, round(y, 12) AS y FROM knots", "fx_ok", **_isotonic("fx_ok")))
def a42(spark: SparkSession, d: str) -> DataFrame:
    knots = CAL.fit("isotonic", X.apply_missing_policy(V.scores(spark, d))).knots
    return knots.select("x", F.round("y", 12).alias("y"))


@query(
    "a43_isotonic_table",
    with_views(
        """SELECT dataset, key, compression, status, round(CASE WHEN score IS NULL THEN NULL WHEN k.x IS NULL THEN (SELECT y FROM knots ORDER BY x LIMIT 1)
  WHEN k.x1 IS NULL THEN k.y ELSE k.y + (score - k.x) / (k.x1 - k.x) * (k.y1 - k.y) END, 9) AS score
FROM fx_scores s ASOF LEFT JOIN pieces k ON s.score >= k.x""",
        "fx_ok",
        src="SELECT * FROM fx_ok WHERE dataset = 'ds0'",
        **_isotonic("src"),
        pieces="SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM knots",
    ),
)
def a43_isotonic(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores(spark, d)
    out, _ = CAL.calibrate(rows.where("dataset = 'ds0'"), rows, "isotonic")
    return out.select("dataset", "key", "compression", "status", r9("score").alias("score"))


@query("a43_calibrated_table")
def a43(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores(spark, d)
    out, _ = CAL.calibrate(rows.where("dataset = 'ds0'"), rows, "platt")
    return out.select("dataset", "key", "compression", "label", "score", "status")


@query(
    "p17_calibrated_projection",
    with_views(
        """SELECT key, compression, status, round(CASE WHEN status = 'ok' THEN 1 / (1 + exp(-(1.7 * ln(p / (1 - p)) - 0.4))) END, 9) AS score,
  round(CASE WHEN status = 'ok' THEN 1 / (1 + exp(-ln(p / (1 - p)) / 2.5)) END, 9) AS tempered FROM (SELECT *, least(greatest(score, 1e-6), 1 - 1e-6) AS p FROM fx_scores)""",
        "fx_scores",
    ),
)
def p17(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scores(spark, d).withColumn("tempered", F.col("score"))
    out = CAL.apply_scores(CAL.Calibration("platt", {"a": 1.7, "b": -0.4}), rows)
    out = CAL.apply_scores(CAL.Calibration("temperature", {"T": 2.5}), out, "tempered")
    return out.select("key", "compression", "status", r9("score").alias("score"), r9("tempered").alias("tempered"))
