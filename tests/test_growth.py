"""What the work of a query grows with: how often plans compute, scan or call."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scoreloom.plans import datasets as D
from scoreloom.plans import inventory as INV
from scoreloom.plans import release as REL
from scoreloom.plans import scoring as SC
from scoreloom.operators import coverage as C
from scoreloom.plans import views as V
from scoreloom.sources import lines as LN


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_place_is_looked_up_once_a_row(spark):
    folder = "original_content/real/frames/224w_224h_wild_precropped"
    names = ["real_train_6_1/0.PNG", "real_train_6_1/.PNG", "real_train_6_1/a.jpg", "real_test_6_2/x.y.png", "real_test_6_2/1.pNg"]
    listing = spark.createDataFrame([(f"{folder}/{n}",) for n in [*names, "real_test_6_2/../0.PNG/"]] + [("0.PNG",)], "relpath string")
    rows = INV.parse_listing(INV.wild_folders(listing), D.WILD, folders=True)
    # once as a key of the constant map, once in its value
    assert optimized(rows).count(folder) == 2
    assert {(r["key"], r["attrs"]["n_frames"]) for r in rows.collect()} == {("REAL/real_train_6_1", "1"), ("REAL/real_test_6_2", "2")}


def test_first_lists_are_found_by_hashing(spark):
    rows = [("a", "val"), ("a", "train"), ("b", "test"), ("b", "val"), ("c", "other"), (None, "test")]
    lists = spark.createDataFrame(rows, "id string, split string")
    for order, want in ((("train", "val", "test"), {"a": "train", "b": "val", None: "test"}), (("test", "val", "train"), {"a": "val", "b": "test", None: "test"})):
        first = INV.first_listed(lists, order)
        assert "SortAggregate" not in first._jdf.queryExecution().executedPlan().toString()
        assert {r["id"]: r["split"] for r in first.collect()} == want


def test_records_without_a_side_key_are_dealt_over_all_tasks(spark):
    rows = [(f"original_content/fr/videos/fr_{i}.mp4",) for i in range(3)] + [(f"manipulated_content/to_ru/videos/fr_{i}.mp4",) for i in range(4000)]
    rows += [(f"manipulated_content/to_zh/videos/fr_{i}_to_zh_tts.mp4",) for i in range(3)]
    listing = spark.createDataFrame(rows, "relpath string")
    side = spark.createDataFrame([("fr_1.mp4", "film"), (None, "nobody")], "side_id string, speaker string").hint("merge")
    key = F.when(F.col("kind") == "real", F.col("file_name")).otherwise(F.concat(F.nullif(D.dub_real(F.col("stem")), F.lit("")), F.lit(".mp4")))
    found = INV.parse_listing(listing, D.PGF, side=side, side_key=key)
    with_side = {r["key"]: r["identity"] for r in found.where("identity = 'film'").collect()}
    assert with_side == {"FR/fr_1": "film", "LS_TO_ZH/fr_1_to_zh_tts": "film"} and found.count() == 4006
    _spread(spark, found, 4006)


def test_fakes_without_a_driver_are_dealt_over_all_tasks(spark):
    fakes = [(f"TH_M1/{i}", f"{i}.mp4", None, None) for i in range(4000)] + [("TH_LP/1--d--LivePortrait", "x.mp4", "d", None), ("REAL_CVHQ/d", "d.mp4", None, "d")]
    rows = spark.createDataFrame(fakes, "key string, relpath string, source_id string, identity string")
    lists = spark.createDataFrame([("CelebV-HQ", "d", "train"), ("CelebV-HQ", "d", "val"), ("CelebV-HQ", None, "val")], "source string, id string, split string")
    out = INV.official_splits(D.THB, rows, lists.hint("merge"))
    got = {r["key"]: r["split"] for r in out.collect()}
    assert len(got) == 4002 and got["TH_LP/1--d--LivePortrait"] == "train" and got["REAL_CVHQ/d"] == "val"
    assert got["TH_M1/7"] == "test"
    _spread(spark, out, 4002)


def _spread(spark, rows, n):
    """No task of the last stage has most of the n rows."""
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        most = max(r["count"] for r in rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    assert most < n / 2


def test_a_driver_keeps_its_dash(spark):
    lists = spark.createDataFrame([("CelebV-HQ", "-a"), ("CelebV-HQ", "-a"), ("CelebV-HQ", "-b"), ("CelebV-HQ", "b"), ("FF", "c"), ("CelebV-HQ", None)], "source string, id string")
    side = INV.driver_side(lists)
    assert "SortAggregate" not in side._jdf.queryExecution().executedPlan().toString()
    assert {r["side_id"]: r["driver"] for r in side.collect()} == {"-a": "-a", "a": "-a", "-b": "-b", "b": "b", None: None}


def test_records_are_put_together_where_they_are_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,n\n"a\nb",1\n\nc,"2\n\n3"\n')
    records = LN.read_records(spark, str(tmp_path))
    assert sorted((r["line"], r["value"]) for r in records.collect()) == [(1, "k,n"), (2, '"a\nb",1'), (5, 'c,"2\n\n3"')]
    # only pieces of records that lie across blocks are joined or dealt, from what is written once
    assert "Join" not in optimized(records) and "text" not in records._jdf.queryExecution().executedPlan().toString().split("Scan ")[1][:8]


def test_a_half_known_to_fail_is_not_tried(spark):
    calls = []

    def scorer(rows):
        calls.append(len(rows))
        if (rows["key"] == "k63").any():
            raise ValueError("unreadable clip")
        return rows["clip_index"] / 100

    rows = pd.DataFrame({"dataset": "d", "key": [f"k{i}" for i in range(64)], "compression": None, "clip_index": np.arange(64)})
    out = pd.concat(SC.scored_batches(scorer)(iter([rows])))
    assert out["key"][out["failure"].notna()].tolist() == ["k63"] and out["clip_score"].notna().sum() == 63
    assert calls == [64, 32, 16, 8, 4, 2, 1, 1]


def test_medians_of_short_and_long_videos(spark, monkeypatch):
    monkeypatch.setattr(C, "SORTED_CLIPS", 5)
    rng = np.random.default_rng(3)
    rows = [(f"v{n}" if n else None, float(x)) for n in range(12) for x in rng.integers(0, 9, n + 1) / 8] + [("none", None), ("v3", None), ("v9", None), *[("gone", None)] * 7]
    got = {r["key"]: (r["score"], r["n_clips"]) for r in C.clip_to_video(spark.createDataFrame(rows, "key string, score double"), ["key"], "median").collect()}
    for key in {k for k, _ in rows}:
        values = [x for k, x in rows if k == key]
        known = [x for x in values if x is not None]
        assert got[key] == (np.median(known) if known else None, len(values)), key
    assert len(got) == 14


def test_scores_join_reduced_line_items(spark, sf):
    assert optimized(V.scores(spark, sf)).count("Join") == 1


def test_lists_held_are_computed_once(spark):
    v = spark.createDataFrame([("REAL/a", None, "X-REAL", "p"), ("FAKE/b", None, "X-FAKE", "p")], "key string, compression string, label_key string, identity string")
    built = REL.build_dataset(v, {"all": ("all-test", {})}, is_real=v.key.startswith("REAL"), candidates=v.key, task_rank={}, pairing_rule=None)
    kept = REL.held(built)
    for df in (kept.videos, kept.pairs, kept.schemes["all"]):
        assert optimized(df).startswith("Relation")
    plan = kept.fingerprints._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum(cast" not in plan and "decimal(20,0))#" not in plan.split("Aggregate")[-1]
    assert sorted(map(tuple, kept.fingerprints.collect())) == sorted(map(tuple, built.fingerprints.collect()))
