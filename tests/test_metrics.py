"""Metrics against direct numpy definitions, and small hand-worked cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError
from scoreloom.functions.range_metrics import METRICS, Range, inner_quantiles
from scoreloom.operators import metrics as M


def naive(y, p, name, **kw):
    y, p = np.asarray(y), np.asarray(p, float)
    pos, neg = p[y == 1], p[y == 0]
    if name == "auc":
        return np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    cuts = np.unique(p)[::-1]
    tpr = np.r_[0, [np.mean(pos >= c) for c in cuts]] if len(pos) else None
    fpr = np.r_[0, [np.mean(neg >= c) for c in cuts]] if len(neg) else None
    if name == "ap":
        prec = [np.mean(y[p >= c]) for c in cuts]
        return float(np.sum(np.diff(tpr) * prec))
    if name == "eer":
        d = fpr - (1 - tpr)
        i = int(np.argmax(d >= 0))
        t = -d[i - 1] / (d[i] - d[i - 1])
        return fpr[i - 1] + t * (fpr[i] - fpr[i - 1])
    if name == "tpr":
        if kw.get("interp"):
            return float(np.interp(kw["fpr"], fpr, tpr))
        return tpr[fpr <= kw["fpr"]].max()
    if name == "fpr":
        if kw.get("interp"):
            return float(np.interp(kw["tpr"], tpr, fpr))
        return fpr[tpr >= kw["tpr"]].min()
    if name == "acc":
        return np.mean((p >= kw.get("thr", 0.5)) == (y == 1))
    if name == "brier":
        return np.mean((p - y) ** 2)
    if name == "nll":
        c = np.clip(p, 1e-7, 1 - 1e-7)
        return -np.mean(np.where(y == 1, np.log(c), np.log(1 - c)))
    if name == "ece":
        bins = kw.get("bins", 15)
        edges = np.quantile(p, np.linspace(0, 1, bins + 1)) if kw.get("adaptive") else np.linspace(0, 1, bins + 1)
        total = 0.0
        for b in range(bins):
            m = (p >= edges[b]) & ((p <= edges[b + 1]) if b == bins - 1 else (p < edges[b + 1]))
            if m.any():
                total += m.mean() * abs(p[m].mean() - y[m].mean())
        return total
    raise KeyError(name)


CASES = [
    ("auc", {}), ("ap", {}), ("eer", {}), ("acc", {}), ("acc", {"thr": 0.3}), ("brier", {}), ("nll", {}),
    ("tpr", {"fpr": 0.0}), ("tpr", {"fpr": 0.1}), ("tpr", {"fpr": 0.1, "interp": True}), ("tpr", {"fpr": 1.0, "interp": True}),
    ("fpr", {"tpr": 0.9}), ("fpr", {"tpr": 0.0}), ("fpr", {"tpr": 0.9, "interp": True}), ("fpr", {"tpr": 0.0, "interp": True}),
    ("ece", {}), ("ece", {"bins": 10}), ("ece", {"bins": 1}), ("ece", {"adaptive": True, "bins": 4}),
]


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(5)
    data = []
    for g in range(12):
        n = int(rng.integers(6, 80))
        y = rng.integers(0, 2, n)
        y[:2] = [0, 1]
        p = np.clip(np.round(rng.normal(0.35 + 0.3 * y, 0.2), 1 + g % 3), 0, 1)
        data += [(f"g{g}", int(a), float(b), f"k{i:04d}") for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(data, "g string, label int, score double, key string").cache()


def test_every_metric_matches_its_definition(spark, groups):
    metrics = {f"m{i}": M.metric(n, **kw) for i, (n, kw) in enumerate(CASES)}
    got = {r["g"]: r for r in M.compute(groups, ["g"], metrics).collect()}
    for g, part in groups.toPandas().groupby("g"):
        for i, (n, kw) in enumerate(CASES):
            want = naive(part["label"], part["score"], n, **kw)
            assert got[g][f"m{i}"] == pytest.approx(want, abs=1e-10), (g, n, kw)


@pytest.mark.parametrize("blocks", [1, 6])
def test_aurc_keeps_key_order_in_ties(groups, blocks):
    got = {r["g"]: r["v"] for r in M.compute(groups, ["g"], {"v": M.aurc(blocks=blocks)}).collect()}
    for g, part in groups.toPandas().groupby("g"):
        part = part.sort_values("key")
        conf = np.maximum(part["score"], 1 - part["score"]).to_numpy()
        wrong = ((part["score"] >= 0.5).astype(int) != part["label"]).to_numpy()
        run = np.cumsum(wrong[np.argsort(-conf, kind="stable")])
        assert got[g] == pytest.approx(np.mean(run / np.arange(1, len(run) + 1)), abs=1e-12)


def by_ranges(s, pos, neg, name, cut, **kw):
    """A metric of one histogram from the parts of its ranges, as resampling merges them."""
    order = np.argsort(-s)
    s, pos, neg = s[order], pos[order][None], neg[order][None]
    n_p, n_q = int(pos.sum()), int(neg.sum())
    adaptive = kw.pop("adaptive", False)

    def parts(of, **params):
        out = []
        for at in range(0, len(s), cut):
            here = slice(at, at + cut)
            tp, fp = pos[:, :at].sum(axis=1), neg[:, :at].sum(axis=1)
            out.append(METRICS[of].part(Range(s[here], pos[:, here], neg[:, here], tp, fp, np.zeros(1), n_p, n_q), **params))
        merge = {"sum": np.nansum, "max": np.fmax.reduce, "min": np.fmin.reduce}[METRICS[of].merge]
        return [float(merge(np.array(x), axis=0)[0]) for x in zip(*out)]

    if adaptive:
        found = parts("order_statistics", bins=kw["bins"])
        at = inner_quantiles(kw["bins"]) * (n_p + n_q - 1)
        kw["edges"] = np.array([[lo + (hi - lo) * (a - np.floor(a)) for lo, hi, a in zip(found[::2], found[1::2], at)]])
    merged = parts(name, **kw)
    if name == "ece":
        return sum(map(abs, merged))
    return 1.0 if kw.get("interp") and np.isnan(merged[0]) else merged[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=2, max_size=40), st.integers(1, 9))
def test_metrics_by_ranges_match_definitions(rows, cut):
    y = np.array([0, 1, *[r[0] for r in rows]])
    p = np.array([0.4, 0.6, *[r[1] / 20 for r in rows]])
    s = np.unique(p)
    pos = np.array([np.sum((p == v) & (y == 1)) for v in s])
    neg = np.array([np.sum((p == v) & (y == 0)) for v in s])
    for n, kw in CASES:
        assert by_ranges(s, pos, neg, n, cut, **kw) == pytest.approx(naive(y, p, n, **kw), abs=1e-9), (n, kw)


def test_one_class_is_null_with_a_reason(spark):
    df = spark.createDataFrame([("f", 1, 0.5), ("r", 0, 0.5)], "g string, label int, score double")
    got = {r["g"]: r for r in M.compute(df, ["g"], {"auc": M.auc(), "eer": M.eer(), "brier": M.brier()}).collect()}
    assert got["f"]["auc"] is None and got["f"]["eer"] is None
    assert got["f"]["undefined"] == "every label is fake" and got["r"]["undefined"] == "every label is real"
    assert got["f"]["brier"] == 0.25


def test_edges_of_bins_are_literal(spark):
    df = spark.createDataFrame([(0.3,)], "s double").select(M.equal_width_bin(F.col("s"), 10).alias("b"))
    assert df.first().b == 2  # 0.3 lies below the third inner edge, 0.30000000000000004


def test_first_segment_threshold_is_the_top_score(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.9)], "label int, score double")
    got = M.compute(df, [], {"eer": M.eer(), "thr": M.eer_threshold()}).first()
    assert (got.eer, got.thr) == (0.5, 0.9)


def test_bad_parameters_are_refused():
    with pytest.raises(ConfigError):
        M.tpr(fpr=1.5)
    with pytest.raises(ConfigError):
        M.metric("nope")
