"""Keys, texts, pairs, scans, scoring and publishing on small inputs."""

import hashlib
import os
import random
import re
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError, ContractError
from scoreloom.functions import keys as K
from scoreloom.functions import scores as X
from scoreloom.operators import fingerprint as FP
from scoreloom.operators import joins as J
from scoreloom.operators import logs as L
from scoreloom.operators import pairs as P
from scoreloom.operators import records as R
from scoreloom.operators import splits as S
from scoreloom.plans import datasets as D
from scoreloom.plans import importing as IMP
from scoreloom.plans import inventory as INV
from scoreloom.plans import release as REL
from scoreloom.plans import scoring as SC
from scoreloom.sources import records as SR


def texts(spark, values, **columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *[c.alias(k) for k, c in columns.items()]).orderBy("i").collect()]


def test_path_guard_and_cut(spark):
    cases = {
        "/data/x/000.mp4": (True, "000.mp4"),
        "run:/x/y": (True, "run:y"),
        "file:///a/b.png": (True, "b.png"),
        "~/q/r": (True, "r"),
        "see https://a.b/home/c": (False, "see https://a.b/home/c"),
        "real / fake": (False, "real / fake"),
        "a/b/c": (False, "a/b/c"),
        "cannot open '/mnt/d/e f'": (True, "cannot open 'e f'"),
        "(/x/y/)": (True, "(y)"),
    }
    t = F.col("t")
    got = texts(spark, cases, a=K.has_absolute_path(t), b=K.portable_text(t))
    assert dict(zip(cases, got)) == cases
    leaks = texts(spark, ["in the /home/ folder", "https://x/home/y", r"C:\x", "fine"], a=K.leaks_local_path(t))
    assert [r[0] for r in leaks] == [True, False, True, False]


def test_key_parts_and_hashes(spark):
    keys = ["REAL/0/1", "plain", "/x", "a/"]
    t = F.col("t")
    got = texts(spark, keys, a=K.task_of(t), b=K.task_or_key(t), c=K.local_key(t), d=K.draw_seed(3, 4, F.col("i")).cast("string"),
                e=K.hash_uniform(1, F.lit("d"), t, F.lit(None).cast("string")))
    for i, (k, row) in enumerate(zip(keys, got)):
        head, sep, rest = k.partition("/")
        assert row[:3] == (head if sep else "", head, rest if sep else k)
        assert int(row[3]) == int.from_bytes(hashlib.sha256(f"3:4:{i}".encode()).digest()[:8], "big")
        assert row[4] == int.from_bytes(hashlib.sha256(f"1|d|{k}|".encode()).digest()[:8], "big") / 2**64


def test_stems_are_those_of_posix_paths(spark):
    paths = ["a/b.mp4", "b.tar.gz", ".hidden", "a/.x.mp4", "no", "a.b/c"]
    got = texts(spark, paths, s=K.stem_of(F.col("t")))
    assert [r[0] for r in got] == [PurePosixPath(p).stem for p in paths]


def test_decimal_text_is_pythons(spark):
    values = [0.0, 1.0, 0.5, 0.0005, 0.00012345, 1e-05, 1.5e-07, 3e-10, 0.001, 0.1234567890123456, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in df.select("i", SR.decimal_text(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [None if v is None else repr(v) for v in values]


@pytest.mark.parametrize("cap", [None, 0, 1, 3])
def test_pairs_equal_a_plain_search(spark, cap):
    rng = random.Random(cap or 9)
    rows = []
    for i in range(300):
        task = rng.choice(["REAL", "ALT", "FAKE"])
        who = "hot" if rng.random() < 0.4 else f"p{rng.randrange(12)}"
        rows.append((f"{task}/{rng.randrange(120)}", rng.choice([None, "c23"]), who, rng.choice(["hot", "p3", "7", "50", "", "zz"])))
    df = spark.createDataFrame(rows, "key string, compression string, identity string, want string")
    rank = {"ALT": 0, "REAL": 1, "FAKE": 2}
    real = ~F.col("key").startswith("FAKE")
    got = P.resolve_pairs(df, is_real=real, candidates=F.array("want", "identity"), fanout_cap=cap, rule="r", task_rank=rank)
    local = lambda k: k.split("/")[1]
    reals = [r for r in rows if not r[0].startswith("FAKE")]
    order = lambda k: (local(k), rank[k.split("/")[0]], k.split("/")[0])
    want = set()
    for r in rows:
        if not r[0].startswith("FAKE"):
            continue
        for value in (r[3], r[2]):
            if not value:
                continue
            hits = sorted({q[0] for q in reals if local(q[0]) == value}, key=order)
            if not hits:
                hits = sorted({q[0] for q in reals if q[2] == value}, key=order)[:cap]
            want |= {(r[0], h) for h in hits}
    found = [(r.fake_key, r.real_key) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_negative_cap_is_refused(spark):
    df = spark.createDataFrame([("REAL/1", None, "p")], "key string, compression string, identity string")
    with pytest.raises(ConfigError):
        P.resolve_pairs(df, is_real=F.lit(True), candidates=F.array("identity"), fanout_cap=-1, rule="r")


def test_official_rules(spark):
    v = spark.createDataFrame([(f"REAL/{i}", None, f"p{i}") for i in range(40)], "key string, compression string, identity string")
    listed = spark.createDataFrame([("REAL/0", "test"), ("REAL/1", "exclude"), ("REAL/2", "train")], "key string, split string")
    both = {r.key: r.split for r in S.official_plus_80_20(v, listed, "test-only-official").collect()}
    assert both["REAL/0"] == "test" and both["REAL/1"] == "exclude" and len(both) == 40
    narrow = {r.key: r.split for r in S.official_plus_80_20(v, listed, "official-train-test").collect()}
    assert set(narrow) == {"REAL/0", "REAL/1", "REAL/2"} and narrow["REAL/2"] in ("train", "val")
    with pytest.raises(ConfigError):
        S.assign("official", {}, v)
    assert S.bad_official_rows(listed.union(spark.createDataFrame([("REAL/3", "dev")], "key string, split string"))).count() == 1


def test_where_matches_nulls_and_members(spark):
    v = spark.createDataFrame(
        [("A/1", None, {"lang": "en"}), ("A/2", "c23", {"lang": None}), ("B/3", "c40", {})],
        "key string, compression string, attrs map<string,string>",
    )
    keys = lambda w: sorted(r.key for r in v.where(R.where_condition(w)).collect())
    assert keys({"compression": None}) == ["A/1"]
    assert keys({"compression": [None, "c40"]}) == ["A/1", "B/3"]
    assert keys({"compression": []}) == []
    assert keys({"attrs.lang": None}) == ["A/2", "B/3"]
    assert keys({"task": "A", "attrs.lang": ["en"]}) == ["A/1"]
    with pytest.raises(ConfigError):
        R.check_where(v, {"nope": 1})


def test_listing_and_jsonl_guards(spark, tmp_path):
    for name in ("a/1.MP4", "a/.2.mp4", "a/.h/3.mp4", "b/4.txt", "5.mkv"):
        p = tmp_path / "m" / name
        os.makedirs(p.parent, exist_ok=True)
        p.write_bytes(b"x")
    got = SR.list_media(spark, str(tmp_path / "m"), D.VIDEO_SUFFIXES)
    assert sorted(r.relpath for r in got.collect()) == ["5.mkv", "a/1.MP4"]
    assert SR.list_media(spark, str(tmp_path / "none"), ["mp4"]).count() == 0
    present = {r.folder: r.present for r in SR.folders_with_media(got, ["a", "b"]).collect()}
    assert present == {"a": True, "b": False}
    bad = spark.createDataFrame([("k", {"p": ["ok", "/abs/x"]})], "key string, deep map<string,array<string>>")
    with pytest.raises(ContractError):
        SR.write_jsonl(bad, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    (tmp_path / "s.tsv").write_text("a\t\ttrain\nb\tc23\tdev\n")
    scan = SR.read_split_tsv(spark, str(tmp_path / "s.tsv"))
    assert scan.rows.where("key = 'a'").first().compression is None
    with pytest.raises(ContractError):
        scan.checked()


def test_run_ledger_and_named_lists(spark, tmp_path):
    import json

    from scoreloom.sources import lists as LS

    for run, docs in {
        "exp/r1": {"env.json": {"seed": 1, "created": "x"}, "metrics.json": {"epochs": 5, "monitor": {"key": "auc", "best": 0.9}}},
        "exp/r2": {"env.json": {"created": "y"}, "resume/state.json": {"seed": 7, "epoch": 2}},
    }.items():
        for name, doc in docs.items():
            p = tmp_path / "runs" / run / name
            os.makedirs(p.parent, exist_ok=True)
            p.write_text(json.dumps(doc, indent=1))
    (tmp_path / "runs/exp/r1/data.json").write_text(json.dumps(
        {"train": [{"name": "a", "protocol": {"ref": "p", "split": "train"}, "index": {"sources": [{"counts": {"in_split": 9, "included": 8}}]}}], "val": []}))
    got = {r.run: (r.name, r.seed, r.status, r.epochs) for r in SR.list_runs(spark, str(tmp_path / "runs")).collect()}
    assert got == {"r1": ("exp", 1, "completed", 5), "r2": ("exp", 7, "incomplete", 2)}
    data = SR.run_data(spark, str(tmp_path / "runs")).collect()
    assert [(r.role, r.name, r.in_split, r.included) for r in data] == [("train", "a", 9, 8)]
    os.makedirs(tmp_path / "lists")
    (tmp_path / "lists/train.json").write_text('[["000", "003"], "7"]')
    (tmp_path / "lists/test.json").write_text('[["1", "2"]]')
    ids = {(r.id, r.split) for r in LS.json_id_lists(spark, str(tmp_path / "lists")).collect()}
    assert ids == {("000", "train"), ("003", "train"), ("7", "train"), ("1", "test"), ("2", "test")}
    (tmp_path / "thb.json").write_text('{"Train": {"CelebV-HQ": ["-a.mp4"]}, "Test": {"CelebV-HQ": ["b.mp4"]}}')
    rows = {(r.source, r.id, r.split) for r in LS.source_split_object(spark, str(tmp_path / "thb.json")).collect()}
    assert rows == {("CelebV-HQ", "-a", "train"), ("CelebV-HQ", "b", "test")}
    (tmp_path / "def.csv").write_text("identity,split\n 5 ,TRAIN\n6,other\n")
    assert [tuple(r) for r in LS.csv_split_definition(spark, str(tmp_path / "def.csv")).collect()] == [("5", "train")]


def test_score_table_contract(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿dataset,key,compression,label,score,status,x_note\nd,k,,1,0.5,ok,hi\nd,j,c23,0,,missing,\n", encoding="utf-8")
    rows = {r["key"]: r for r in SR.read_scores(spark, str(tmp_path / "x.csv")).checked().collect()}
    assert rows["k"]["compression"] is None and rows["k"]["x"] == {"x_note": "hi"} and rows["j"]["score"] is None
    (tmp_path / "y.csv").write_text("dataset,key,compression,label,score,status,odd\nd,k,,1,0.5,ok,1\n")
    with pytest.raises(ContractError):
        SR.read_scores(spark, str(tmp_path / "y.csv"))
    (tmp_path / "z.csv").write_text("dataset,key,compression,label,score,status\nd,k,,1,1.5,ok\nd,j,,1,0.5,missing\nd,i,,x,0.5,done\n")
    problems = {(r["key"], r["problem"]) for r in SR.read_scores(spark, str(tmp_path / "z.csv")).problems.collect()}
    assert problems == {
        ("k", "ok needs a score in [0, 1]"), ("j", "only ok rows carry a score"),
        ("i", "label is not an integer"), ("i", "unknown status"), ("i", "only ok rows carry a score"),
    }


def test_fingerprints_ignore_order_and_count_repeats(spark):
    rows = [(f"k{i}", None if i % 2 else "c", "train") for i in range(50)]
    df = lambda r: spark.createDataFrame(r, "key string, compression string, split string")
    fp = lambda r: FP.fingerprint(df(r), FP.split_line()).first()
    shuffled = random.Random(1).sample(rows, 50)
    assert fp(rows) == fp(shuffled) != fp(rows + rows[:1])


def test_publish_moves_the_pointer_only_when_lists_match(spark, tmp_path):
    v = spark.createDataFrame([(f"REAL/{i}", None, f"p{i}", "REAL") for i in range(9)], "key string, compression string, identity string, label_key string")
    build = lambda rows: REL.build_dataset(rows, {"all": ("all-test", {})}, is_real=F.lit(True), candidates=F.array("identity"),
                                           task_rank={"REAL": 0}, pairing_rule=None)
    root = str(tmp_path / "ds")
    one = build(v)
    REL.publish(one, root, "1", one.fingerprints)
    with pytest.raises(ContractError):
        REL.publish(build(v.limit(5)), root, "2", one.fingerprints)
    assert REL.current(spark, root).endswith("/1")
    twice = build(v.unionAll(v))
    with pytest.raises(ContractError):
        REL.write_dataset(twice, str(tmp_path / "x"), {})


def test_scoring_isolates_the_video_at_fault(spark):
    rows = [("d", f"k{v}", None if v % 2 else "c", c) for v in range(30) for c in range(3)]
    clips = spark.createDataFrame(rows, "dataset string, key string, compression string, clip_index int").repartition(2)

    def scorer(batch: pd.DataFrame):
        if (batch["key"] == "k7").any():
            raise RuntimeError("broken")
        out = batch["clip_index"].to_numpy() / 4.0
        out[(batch["key"] == "k8").to_numpy()] = np.nan
        return out

    got = SC.score_clips(clips, scorer).collect()
    assert len(got) == 90
    assert {r.key for r in got if r.failure} == {"k7", "k8"}
    assert all(r.clip_score == r.clip_index / 4 for r in got if not r.failure)
    videos = spark.createDataFrame([("d", f"k{v}", None if v % 2 else "c", "REAL", "m") for v in range(31)],
                                   "dataset string, key string, compression string, label_key string, method string")
    mapping = spark.createDataFrame([("REAL", "0")], "label_key string, mapped string")
    rows = {r.key: r.status for r in SC.video_rows(SC.score_clips(clips, scorer), videos, mapping).collect()}
    assert len(rows) == 31 and rows["k30"] == "missing" and rows["k7"] == rows["k8"] == "error" and rows["k1"] == "ok"


@pytest.mark.parametrize("mode", ["mean-prob", "max", "median"])
def test_the_scorer_runs_once_per_clip(spark, tmp_path, mode):
    clips = spark.createDataFrame([("d", f"k{v}", None, c) for v in range(5) for c in range(4)],
                                  "dataset string, key string, compression string, clip_index int")
    videos = spark.createDataFrame([("d", f"k{v}", None, "REAL", "m") for v in range(6)],
                                   "dataset string, key string, compression string, label_key string, method string")
    mapping = spark.createDataFrame([("REAL", "0")], "label_key string, mapped string")
    seen = spark.sparkContext.accumulator(0)

    def scorer(batch):
        seen.add(len(batch))
        return batch["clip_index"] / 4.0

    rows = {r.key: r for r in SC.video_rows(SC.score_clips(clips, scorer), videos, mapping, mode=mode).collect()}
    assert seen.value == 20
    want = {"mean-prob": 0.375, "max": 0.75, "median": 0.375}[mode]
    assert rows["k0"].score == want and rows["k0"].n_clips == 4 and rows["k5"].status == "missing"


def test_import_reports_double_matches(spark):
    videos = spark.createDataFrame([("d", "REAL/1", None, "REAL", "m"), ("d", "REAL/2", "a", "REAL", "m"), ("d", "REAL/2", "b", "REAL", "m")],
                                   "dataset string, key string, compression string, label_key string, method string")
    mapping = spark.createDataFrame([("REAL", "0")], "label_key string, mapped string")
    foreign = spark.createDataFrame([(1, "1", "", "0.5"), (2, "1", "", "0.6"), (3, "2", "a", "0.7"), (4, "2", "z", "0.1")],
                                    "line int, id string, comp string, p string")
    _, problems = IMP.import_scores(foreign, videos, mapping, key="REAL/{id}", score="p", line="line", compression="comp")
    got = {(r.problem, r.line) for r in problems.collect()}
    assert got == {("names a video twice", 2), ("matches no video", 4)}
    table, _ = IMP.import_scores(foreign.where("line = 3"), videos, mapping, key="REAL/{id}", score="p", line="line", compression="comp", polarity="real-high")
    rows = {(r.key, r.compression): (r.status, r.score) for r in table.collect()}
    assert rows[("REAL/2", "a")][0] == "ok" and rows[("REAL/2", "a")][1] == pytest.approx(0.3)
    assert rows[("REAL/1", None)] == ("missing", None) and len(rows) == 3
    with pytest.raises(ConfigError):
        X.compose_key("{nope}", ["a"])


def test_fold_keeps_ok_rows(spark):
    index = spark.createDataFrame([("a", None, 1, "ok"), ("b", None, 2, "error"), ("c", None, 3, "ok")], "key string, compression string, seq int, status string")
    shards = spark.createDataFrame([("a", None, 9, "no_face", 0), ("b", None, 8, "no_face", 0), ("c", None, 7, "ok", 1), ("d", None, 6, "ok", 1), ("d", None, 5, "no_face", 1)],
                                   "key string, compression string, seq int, status string, shard int")
    got = {r.key: (r.seq, r.status) for r in L.fold_shards(index, shards).collect()}
    assert got == {"a": (1, "ok"), "b": (8, "no_face"), "c": (7, "ok"), "d": (6, "ok")}


def test_frame_repair_ties_go_to_the_earlier(spark):
    stored = spark.createDataFrame([("v", i, i in (2, 6)) for i in range(9)] + [("w", i, False) for i in range(3)], "k string, position int, good boolean")
    clips = spark.createDataFrame([("v", 0, p) for p in (3, 4, 5)] + [("v", 1, 2), ("v", 1, 8), ("w", 0, 1)], "k string, clip_index int, position int")
    got = {(r.k, r.clip_index, r.position): r.replacement for r in J.repair_frames(clips, stored, ["k"]).collect()}
    assert got == {("v", 0, 3): 2, ("v", 0, 4): 2, ("v", 0, 5): 6, ("v", 1, 2): 2, ("v", 1, 8): 2, ("w", 0, 1): None}


def test_releases_are_consistent():
    for r in D.RELEASES.values():
        assert {t.abbr for t in r.tasks} == set(r.labels)
        assert len({t.abbr for t in r.tasks}) == len(r.tasks)
        assert all((t.kind == "real") <= (r.labels[t.abbr].binary == 0) for t in r.tasks)


def test_inventory_problem_table_is_empty_for_parsed_files(spark):
    listing = spark.createDataFrame([("original/p1.mkv",), ("blend-a/p1_p2.mkv",), ("other/x.mkv",)], "relpath string")
    rows = INV.parse_listing(listing, D.SYNTHETIC)
    assert rows.count() == 2 and INV.problems(rows, D.SYNTHETIC).count() == 0
    assert INV.problems(rows.unionAll(rows), D.SYNTHETIC).count() == 2


def test_no_reference_names_in_the_package():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "scoreloom")):
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f)).read()
                assert not re.search("localCheckpoint", text), f


def test_scored_batches_come_back_whole():
    """Failing videos leave one batch for each batch, with every other video scored."""

    def scorer(rows):
        if rows["key"].str.endswith("7").any():
            raise ValueError("unreadable clip")
        return rows["clip_index"] / 100

    keys = [f"k{i % 50}" for i in range(300)]
    rows = pd.DataFrame({"dataset": "d", "key": keys, "compression": None, "label": 0, "clip_index": np.arange(300) % 90})
    out = list(SC.scored_batches(scorer)(iter([rows, rows.iloc[:0], rows.iloc[:9]])))
    assert [len(x) for x in out] == [300, 9]
    for part in out:
        bad = part["key"].str.endswith("7")
        assert (part["failure"].notna() == bad).all() and set(part["failure"].dropna()) == {"ValueError: unreadable clip"}
        assert part["clip_score"].isna().equals(bad) and np.allclose(part["clip_score"][~bad], part["clip_index"][~bad] / 100)
