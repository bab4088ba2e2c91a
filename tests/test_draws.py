"""Seeded draws against plain Python, resampling laws, batches, and calibration fits."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.functions import frames as FR
from scoreloom.functions.range_metrics import METRICS, Range
from scoreloom.operators import bootstrap as B
from scoreloom.operators import calibrate as CAL
from scoreloom.operators import compare as CMP
from scoreloom.operators import metrics as M
from scoreloom.operators import ordered as O
from scoreloom.operators import sampling as SA
from scoreloom.operators import splits as S

RANK = {"REAL": 0, "FAKE_A": 1, "FAKE_B": 2}


@pytest.fixture(scope="module")
def videos(spark):
    rng = random.Random(11)
    rows = []
    for i in range(900):
        task = rng.choice(["REAL", "REAL", "FAKE_A", "FAKE_B"])
        who = "p0" if i % 3 == 0 else f"p{rng.randrange(40)}"
        rows.append((f"{task}/{i}", rng.choice([None, "c23", "c40"]), who))
    return spark.createDataFrame(rows, "key string, compression string, identity string").cache()


def plain_benchmark(rows, spec):
    """The draw as its steps say, on a list."""
    task = lambda r: r[0].split("/")[0]
    pool = [r for r in rows if task(r) not in spec.exclude_tasks]
    if spec.compressions is not None:
        pool = [r for r in pool if r[1] in spec.compressions]
    pool.sort(key=lambda r: (r[0].split("/", 1)[1], RANK[task(r)], r[1] or ""))
    fakes, reals = [r for r in pool if task(r) != "REAL"], [r for r in pool if task(r) == "REAL"]
    rng = random.Random(spec.seed)
    field = {"identity": lambda r: r[2] or "", "task": task}
    strata = {}
    for r in fakes:
        strata.setdefault(tuple(field[s](r) for s in spec.strata), []).append(r)
    chosen = []
    for _, members in sorted(strata.items()):
        chosen += members if len(members) <= spec.k_fake else rng.sample(members, spec.k_fake)
    picked = reals if len(reals) <= len(chosen) else rng.sample(reals, len(chosen))
    if spec.k_real_cap is not None and len(picked) > spec.k_real_cap:
        picked = rng.sample(picked, spec.k_real_cap)
    return {(r[0], r[1]) for r in chosen + picked}


SPECS = [
    {"k_fake": 50, "seed": 3},
    {"k_fake": 3, "strata": ("identity", "task"), "seed": 1},
    {"k_fake": 9, "strata": ("task",), "seed": 2, "k_real_cap": 7, "compressions": ("c23",)},
    {"k_fake": 10**6, "exclude_tasks": ("FAKE_B",)},
]


@pytest.mark.parametrize("blocks", [1, 5])
@pytest.mark.parametrize("params", SPECS)
def test_benchmark_equals_the_plain_draw(videos, params, blocks):
    spec = S.BenchmarkSpec(**params, draw="sequence")
    got = S.benchmark(videos, spec, is_real=F.col("key").startswith("REAL"), task_rank=RANK, blocks=blocks)
    rows = [tuple(r) for r in videos.collect()]
    found = [(r["key"], r["compression"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_benchmark(rows, spec)


@pytest.mark.parametrize("digits", [1, 4])
@pytest.mark.parametrize("params", [*SPECS, {"k_fake": 0}, {"k_fake": 5, "k_real_cap": 0}])
def test_hashed_benchmark_takes_the_smallest_hashes(videos, monkeypatch, params, digits):
    monkeypatch.setattr(O, "HASH_DIGITS", digits)
    spec = S.BenchmarkSpec(**params)
    got = S.benchmark(videos, spec, is_real=F.col("key").startswith("REAL"), task_rank=RANK)
    task = lambda r: r[0].split("/")[0]
    pool = [tuple(r) for r in videos.collect()]
    pool = [r for r in pool if task(r) not in spec.exclude_tasks and (spec.compressions is None or r[1] in spec.compressions)]
    pool.sort(key=lambda r: hashlib.md5(f"{spec.seed}:{r[0]}:{r[1] or ''}".encode()).hexdigest())
    field = {"identity": lambda r: r[2] or "", "task": task}
    strata: dict = {}
    for r in pool:
        if task(r) != "REAL":
            strata.setdefault(tuple(field[s](r) for s in spec.strata), []).append(r)
    chosen = [r for members in strata.values() for r in members[: spec.k_fake]]
    n = len(chosen) if spec.k_real_cap is None else min(len(chosen), spec.k_real_cap)
    chosen += [r for r in pool if task(r) == "REAL"][:n]
    assert sorted((r["key"], r["compression"] or "") for r in got.collect()) == sorted((r[0], r[1] or "") for r in chosen)


def test_carves_keep_a_person_on_one_side(videos):
    out = S.carve_72_14_14(videos).join(videos, "key")
    assert out.groupBy("identity").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_carve_hash_is_the_md5_modulo(spark):
    from scoreloom.functions.keys import md5_mod

    words = ["", "p001", "id1_0007", "Ünïcode", "a" * 500]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for n in (7, 100, 997):
        got = {r.w: r.h for r in df.select("w", md5_mod(F.col("w"), n).alias("h")).collect()}
        assert got == {w: int(hashlib.md5(w.encode()).hexdigest(), 16) % n for w in words}


def hist_of(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.clip(np.round(rng.normal(0.4 + 0.2 * y, 0.2), 2), 0, 1)
    rows = spark.createDataFrame(pd.DataFrame({"g": "a", "label": y, "score": p, "score_b": np.round(p**2, 3)}))
    return rows, y, p


@pytest.mark.parametrize("fanout", [B.FANOUT, 5])
def test_bootstrap_interval_has_the_law_of_row_resampling(spark, monkeypatch, fanout):
    monkeypatch.setattr(B, "FANOUT", fanout)
    rows, y, p = hist_of(spark)
    hist = M.score_hist(rows, ["g"])
    got = B.bootstrap_ci(hist, ["g"], "auc", n_boot=600, seed=4).first()
    rng = np.random.default_rng(9)
    pos, neg = p[y == 1], p[y == 0]
    ref = []
    for _ in range(1500):
        a, b = rng.choice(pos, len(pos)), rng.choice(neg, len(neg))
        ref.append(np.mean((a[:, None] > b[None]) + 0.5 * (a[:, None] == b[None])))
    lo, hi = np.quantile(ref, [0.025, 0.975])
    assert got.ci_lo == pytest.approx(lo, abs=0.015) and got.ci_hi == pytest.approx(hi, abs=0.015)
    again = B.bootstrap_ci(hist, ["g"], "auc", n_boot=600, seed=4).first()
    assert (again.ci_lo, again.ci_hi) == pytest.approx((got.ci_lo, got.ci_hi), abs=1e-12)


def test_an_interval_is_the_same_alone_and_beside_others(spark, monkeypatch):
    monkeypatch.setattr(B, "FANOUT", 7)
    mine = hist_of(spark)[0].select("g", "label", "score")
    other = hist_of(spark, 3, 900)[0].select(F.lit("b").alias("g"), "label", "score")
    alone = B.replicate_values(M.score_hist(mine, ["g"]), ["g"], "ap", n_boot=30, seed=2)
    both = M.score_hist(mine.unionByName(other), ["g"])
    values = lambda df: [r["value"] for r in df.where("g = 'a'").orderBy("rep").collect()]
    want = values(alone)
    assert len(want) == 30 and values(B.replicate_values(both, ["g"], "ap", n_boot=30, seed=2)) == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(B, "slices_for", lambda *_: 3)
    for n in (1, 30):
        shuffled = both.repartition(n)
        assert values(B.replicate_values(shuffled, ["g"], "ap", n_boot=30, seed=2)) == pytest.approx(want, abs=1e-12)


def test_the_interval_of_aurc_is_of_its_value(spark):
    """Two distinct scores, so the order within ties is nearly all there is."""
    rng = np.random.default_rng(5)
    data = [("f", f"k{i:04d}", int(y), 0.7 if a else 0.2) for i, (y, a) in enumerate(zip(rng.integers(0, 2, 400), rng.integers(0, 2, 400)))]
    rows = spark.createDataFrame(data, "g string, key string, label int, score double")
    got = B.bootstrap_ci(M.score_hist(rows, ["g"]), ["g"], "aurc", n_boot=200, rows=rows).first()
    assert got.ci_lo < got.value < got.ci_hi and got.ci_hi - got.ci_lo < 0.2
    wrong = np.array([(s >= 0.5) != y for _, _, y, s in data])[np.argsort([-max(s, 1 - s) for *_, s in data], kind="stable")]
    assert got.value == pytest.approx(np.mean(np.cumsum(wrong) / np.arange(1, 401)), abs=1e-12)
    pairs = rows.select("g", F.lit("d").alias("dataset"), "key", F.lit(None).cast("string").alias("compression"), F.col("label").alias("label_a"),
                        F.col("score").alias("score_a"), (1 - F.col("score") / 3).alias("score_b"))
    joint = CMP.joint_hist(pairs, ["g"])
    found = CMP.paired_delta_ci(joint, ["g"], "aurc", n_boot=100, pairs=pairs).first()
    other = pairs.withColumn("score", F.col("score_b")).withColumn("label", F.col("label_a"))
    b = M.compute(other, ["g"], {"v": M.aurc()}).first()["v"]
    assert found.delta_lo < b - got.value < found.delta_hi


@pytest.mark.parametrize("fanout", [B.FANOUT, 5])
def test_paired_interval_sees_the_same_rows_on_both_sides(spark, monkeypatch, fanout):
    monkeypatch.setattr(B, "FANOUT", fanout)
    rows, _, _ = hist_of(spark)
    joint = rows.groupBy("g", F.col("score").alias("score_a"), F.col("score").alias("score_b")).agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")
    )
    for name, params in (("auc", {}), ("ece", {"adaptive": True, "bins": 4}), ("eer", {})):
        got = CMP.paired_delta_ci(joint, ["g"], name, params, n_boot=16).first()
        assert got.delta_lo == pytest.approx(0, abs=1e-12) and got.delta_hi == pytest.approx(0, abs=1e-12)


def test_paired_interval_has_the_law_of_row_resampling(spark, monkeypatch):
    monkeypatch.setattr(B, "FANOUT", 40)
    rows, y, p = hist_of(spark)
    pairs = rows.select("g", F.col("label").alias("label_a"), F.col("score").alias("score_a"), F.col("score_b"))
    other = np.round(p**2, 3)
    joint = CMP.joint_hist(pairs, ["g"])
    got = CMP.paired_delta_ci(joint, ["g"], "acc", n_boot=500, seed=3).first()
    hit = ((other >= 0.5) == y).astype(float) - ((p >= 0.5) == y)
    rng = np.random.default_rng(1)
    ref = [(rng.choice(hit[y == 1], int(y.sum())).sum() + rng.choice(hit[y == 0], int((1 - y).sum())).sum()) / len(y) for _ in range(3000)]
    lo, hi = np.quantile(ref, [0.025, 0.975])
    assert got.delta_lo == pytest.approx(lo, abs=0.02) and got.delta_hi == pytest.approx(hi, abs=0.02)




def test_stratified_resample_is_exact_per_class(videos):
    rows = videos.withColumn("label", F.col("key").startswith("FAKE").cast("int"))
    want = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    for blocks in (1, 4):
        out = B.stratified_resample(rows, ["key"], n_reps=2, seed=3, blocks=blocks)
        got = {(r.rep, r.label): r["count"] for r in out.groupBy("rep", "label").count().collect()}
        assert got == {(rep, k): n for rep in (0, 1) for k, n in want.items()}


def test_label_balanced_draws_are_even(videos):
    rows = videos.withColumn("label", (F.col("key").startswith("FAKE_B")).cast("int"))
    out = SA.label_balanced_draws(rows, ["key"], seed=1, epoch=0, blocks=3)
    counts = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert sum(counts.values()) == 900 and abs(counts[1] - 450) < 75


def test_source_draws_follow_the_weights(videos):
    a, b = videos.where("identity = 'p0'"), videos.where("identity <> 'p0'")
    rows = SA.concat_sources([a, b])
    out = SA.source_weighted_draws(rows, ["key"], [9.0, 1.0], seed=1, epoch=0)
    share = out.where("source_id = 0").count() / 900
    assert abs(share - 0.9) < 0.04


def test_epochs_shuffle_every_row_once(videos):
    places = [
        [r.key for r in SA.epoch_shuffle(videos, ["key"], seed=1, epoch=e, blocks=4).orderBy("place").collect()]
        for e in (0, 0, 1)
    ]
    assert places[0] == places[1] != places[2]
    assert sorted(places[0]) == sorted(places[2]) and len(set(places[0])) == 900


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_packing_equals_the_greedy_fold(spark, block):
    rng = random.Random(block)
    rows = []
    for source in ("a", "b"):
        rows += [(source, i, rng.choice([0, 1, 2, 3, 5, 20])) for i in range(60)]
    df = spark.createDataFrame(rows, "source string, group_index long, size long")
    got = {(r.source, r.group_index): r.batch for r in SA.packed_batches(df, 8, by=["source"], block_rows=block).collect()}
    for source in ("a", "b"):
        fill = batch = 0
        for s, i, n in rows:
            if s != source:
                continue
            if fill and fill + n > 8:
                batch, fill = batch + 1, 0
            fill += n
            assert got[(source, i)] == batch


@pytest.mark.parametrize("sampling", ["uniform", "consecutive"])
def test_train_clips_equal_plain_python(spark, sampling):
    df = spark.createDataFrame([(n, i, c) for n in (3, 10, 57) for i in range(4) for c in (0, 1)], "n long, i long, c long")
    out = SA.train_clips(df, stored="n", sample="i", clip="c", frames=4, clips=2, seed=5, epoch=1, sampling=sampling, stride=2)
    for r in out.collect():
        rng = random.Random(f"5:1:{r.i}")
        if sampling == "uniform":
            want = []
            for k in range(8):
                lo, hi = k * r.n // 8, (k + 1) * r.n // 8 - 1
                want.append(rng.randint(lo, max(lo, hi)))
            want, padded = want[r.c * 4 : r.c * 4 + 4], False
        else:
            start = [rng.randint(0, max(r.n - 8, 0)) for _ in range(2)][r.c]
            raw = [start + 2 * k for k in range(4)]
            want, padded = [min(x, r.n - 1) for x in raw], raw[-1] >= r.n
        assert (r.positions, r.padded) == (want, padded)


def test_spaced_equals_numpy(spark):
    df = spark.range(1, 300).withColumnRenamed("id", "n")
    for k in (1, 4, 8, 33):
        out = df.select("n", FR.sample_indices("uniform", F.col("n"), frames=k).alias("i")).collect()
        for r in out:
            assert r.i == np.unique(np.linspace(0, r.n - 1, k, dtype=int)).tolist()
    assert spark.range(1).select(FR.sample_indices("all", F.lit(0)).alias("i")).first().i == []


def _loss(p, y):
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -p, p))))


def test_calibration_fits_are_optimal(spark):
    rows, y, p = hist_of(spark, seed=2, n=500)
    z = np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    t = CAL.fit("temperature", rows).params["T"]
    grid = np.linspace(0.05, 20, 40001)
    best = grid[np.argmin([_loss(z / g, y) for g in grid])]
    assert t == pytest.approx(best, abs=1e-3)
    f = CAL.fit("platt", rows).params
    base = _loss(f["a"] * z + f["b"], y)
    for da, db in ((1e-3, 0), (-1e-3, 0), (0, 1e-3), (0, -1e-3)):
        assert _loss((f["a"] + da) * z + f["b"] + db, y) >= base
    iso = CAL.fit("isotonic", rows)
    out = CAL.apply_scores(iso, rows).select("score", "label").toPandas()
    # pool adjacent violators on distinct scores, written out
    xs = np.unique(p)
    blocks = [[y[p == x].mean(), (p == x).sum(), 1] for x in xs]
    i = 0
    while i < len(blocks) - 1:
        if blocks[i][0] > blocks[i + 1][0]:
            a, b = blocks[i], blocks.pop(i + 1)
            blocks[i] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]
            i = max(i - 1, 0)
        else:
            i += 1
    fitted = np.repeat([b[0] for b in blocks], [b[2] for b in blocks])
    want = dict(zip(xs.tolist(), fitted.tolist()))
    got = rows.select("score").toPandas()["score"]
    for s, v in zip(got, out["score"]):
        assert v == pytest.approx(want[s], abs=1e-9)


def test_calibrated_table_keeps_every_row(spark):
    rows, _, _ = hist_of(spark)
    table = rows.select(
        F.lit("d").alias("dataset"), F.monotonically_increasing_id().cast("string").alias("key"), "label",
        F.when(F.rand(1) < 0.9, F.col("score")).alias("score"),
    ).withColumn("status", F.when(F.col("score").isNull(), "error").otherwise("ok")).cache()
    out, found = CAL.calibrate(table, table, "platt")
    assert out.count() == table.count() and found.method == "platt"
    assert out.where("status = 'error' AND score IS NOT NULL").count() == 0


def test_delong_zero_variance_is_exact(spark):
    data = [(1, 0.9, 0.9), (1, 0.8, 0.8), (0, 0.1, 0.1), (0, 0.2, 0.2)]
    cols = "label int, score_a double, score_b double"
    joint = lambda d: spark.createDataFrame(d, cols).groupBy("score_a", "score_b").agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).withColumn("g", F.lit("x"))
    same = CMP.with_p_value(CMP.delong(joint(data), ["g"])).first()
    assert (same.z, same.p) == (0.0, 1.0)
    flat = CMP.with_p_value(CMP.delong(joint([(y, a, 0.5) for y, a, _ in data]), ["g"])).first()
    assert flat.z == math.inf and flat.p == 0.0
    few = CMP.delong(joint(data[1:]), ["g"]).first()
    assert few.z is None and few.undefined == "fewer than two rows in a class"


def test_delong_matches_placements(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 60)
    a = np.round(rng.random(60), 1)
    b = np.round(0.5 * a + 0.5 * rng.random(60) + 0.2 * y, 1)
    df = spark.createDataFrame(pd.DataFrame({"g": "x", "label": y, "score_a": a, "score_b": b}))
    joint = df.groupBy("g", "score_a", "score_b").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    got = CMP.delong(joint, ["g"]).first()

    def parts(s):
        k = (s[y == 1][:, None] > s[y == 0][None]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None])
        return k.mean(1), k.mean(0)

    (xa, ya), (xb, yb) = parts(a), parts(b)
    var = np.var(xa - xb, ddof=1) / len(xa) + np.var(ya - yb, ddof=1) / len(ya)
    assert got.z == pytest.approx((xa.mean() - xb.mean()) / math.sqrt(var), abs=1e-9)


def test_holm_example(spark):
    df = spark.createDataFrame([(0, 0.04), (1, 0.01), (2, 0.03), (3, 0.9)], "i int, p double").withColumn("f", F.lit(0))
    got = {r.i: r.p_holm for r in CMP.holm(df, ["f"]).collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.09, 0.04, 0.09, 0.9])


def test_replicates_do_not_depend_on_partitioning(spark):
    s, pos, neg = np.array([0.1, 0.5, 0.9]), np.array([3, 4, 5]), np.array([6, 2, 1])
    rng = np.random.default_rng([1, B.group_stream(("a",)), 7, 0, 0])
    p = rng.multinomial(12, pos[::-1] / 12)[None]
    q = rng.multinomial(9, neg[::-1] / 9)[None]
    want = float(METRICS["auc"].part(Range(s[::-1], p, q, *np.zeros((3, 1)), 12, 9))[0][0])
    hist = spark.createDataFrame(pd.DataFrame({"g": "a", "score": s, "pos": pos, "neg": neg}))
    values = B.replicate_values(hist, ["g"], "auc", n_boot=20, seed=1)
    assert values.where("rep = 7").first()["value"] == pytest.approx(want)
    assert values.coalesce(1).orderBy("rep").toPandas()["value"].tolist() == values.orderBy("rep").toPandas()["value"].tolist()
