"""Files as others write them: own headers, no order, broken cells; and comparisons that must refuse."""

import json

import pytest
from pyspark.sql import functions as F

from scoreloom.errors import ContractError
from scoreloom.operators import compare as CMP
from scoreloom.operators import logs
from scoreloom.operators.metrics import aurc, compute
from scoreloom.plans.report import evaluate
from scoreloom.sources import records as SR

HEAD = "dataset,key,compression,label,score,status"


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_score_files_keep_their_own_columns(spark, tmp_path):
    write(tmp_path, "a.csv", f"{HEAD},n_clips,n_frames\nd,a/1,c23,1,0.9,ok,3,24\n")
    write(tmp_path, "b.csv", f"﻿{HEAD},n_frames,n_clips\nd,a/2,c23,0,0.1,ok,24,3\n")
    write(tmp_path, "c.csv", "key,dataset,score,label,status,compression\na/3,d,0.5,1,ok,c23\n")
    scan = SR.read_scores(spark, str(tmp_path))
    got = {r["key"]: r for r in scan.checked().collect()}
    assert [(got[k]["n_clips"], got[k]["n_frames"]) for k in ("a/1", "a/2", "a/3")] == [(3, 24), (3, 24), (None, None)]
    assert [(got[k]["label"], got[k]["score"], got[k]["file"]) for k in ("a/2", "a/3")] == [(0, 0.1, "b.csv"), (1, 0.5, "c.csv")]


def test_line_breaks_in_cells_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("d", "a/1", "c23", 1, 0.9, "ok", {"x_note": "two\nlines"})], "dataset string, key string, compression string, label int, score double, status string, x map<string,string>")
    with pytest.raises(ContractError, match="line break"):
        SR.write_scores(rows, str(tmp_path / "s"), {})


def test_a_log_without_numbers_keeps_its_order(spark, tmp_path):
    write(tmp_path, "index.jsonl", '{"key":"a/1","compression":"c23","status":"decode_error"}\n{"key":"a/2","compression":"c23","status":"ok"}\n{"key":"a/1","compression":"c23","status":"ok","n_frames":7}\n')
    last = {r["key"]: r for r in logs.latest(SR.read_outcomes(spark, str(tmp_path / "index.jsonl"))).collect()}
    assert (last["a/1"]["status"], last["a/1"]["n_frames"]) == ("ok", 7)
    path = str(tmp_path / "log")
    for batch, status in enumerate(("error", "ok")):
        SR.append_outcomes(spark.createDataFrame([("a/1", "c23", status, None)], "key string, compression string, status string, reason string"), path, batch)
    assert logs.latest(SR.read_outcomes(spark, path)).first()["status"] == "ok"
    with pytest.raises(Exception, match="a row without seq"):
        logs.latest(spark.createDataFrame([("a", None, "ok", None)], "key string, compression string, status string, seq long")).collect()


def test_required_fields_are_reported(spark, tmp_path):
    write(tmp_path, "v.jsonl", '{"key":"r/1"}\n{"key":"r/2","label_key":"A"}\n')
    scan = SR.read_jsonl(spark, str(tmp_path / "v.jsonl"), "key STRING, label_key STRING", required=["key", "label_key"])
    assert [r["problem"] for r in scan.problems.collect()] == ["missing field label_key"]


SCORES = "file string, dataset string, key string, compression string, label int, score double, status string, method string"


def test_reports_keep_row_order_in_ties(spark):
    rows = spark.createDataFrame(
        [("f", "d", f"k/{i}", None, y, s, "ok", "m") for i, (y, s) in enumerate([(1, 0.3), (0, 0.3), (0, 0.7), (1, 0.7)])], SCORES
    )
    want = compute(rows, ["file"], {"v": aurc()}).first()["v"]
    for n_boot in (0, 20):
        out = evaluate(rows, {"aurc": ("aurc", {})}, by="compression", n_boot=n_boot)
        assert out["files"].first()["value"] == pytest.approx(want)
    pooled = evaluate(rows.withColumn("method", F.when(F.col("label") == 1, "m")), {"aurc": ("aurc", {})}, by="method", n_boot=0)
    assert pooled["breakdown"].first()["value"] == pytest.approx(want)


def test_comparisons_refuse_what_has_no_answer(spark):
    one = [("a", "d", "k/1", None, 1, 0.9, "ok", "m"), ("a", "d", "k/2", None, 0, 0.2, "ok", "m")]
    frame = lambda rows: spark.createDataFrame(rows, SCORES)
    brier = {"brier": ("brier", {})}
    with pytest.raises(ContractError, match="two files"):
        CMP.compare(frame(one), brier, n_boot=0)
    flipped = [("b", *r[1:4], 1 - r[4], *r[5:]) for r in one]
    with pytest.raises(ContractError, match="labels differ"):
        CMP.compare(frame(one + flipped), brier, n_boot=0)
    apart = [("b", "d", "z/1", *r[3:]) for r in one[:1]]
    with pytest.raises(ContractError, match="share no"):
        CMP.compare(frame(one + apart), brier, n_boot=0)


@pytest.fixture
def small_blocks(spark):
    """Files cut into blocks of 600 bytes."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_many_blocks_equal_a_csv_reader(spark, tmp_path, small_blocks, end):
    import csv
    import random

    rng = random.Random(4)
    want = []
    for name, head in (("a.csv", ["k", "note", "n"]), ("b.csv", ["note", "two\nlines", "k"]), ("c.csv", ["k"])):
        cell = lambda: "".join(rng.choice(['"', ",", "\n", "x", "yz ", "\r\n", '""']) for _ in range(rng.randrange(9)))
        with open(tmp_path / name, "w", encoding="utf-8", newline="") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(head)
            for i in range(120):
                row = {"k": f"{name}{i}", "note": rng.choice([cell(), "-" * rng.randrange(200)]), "n": str(i), "two\nlines": cell()}
                out.writerow([row[h] for h in head])
                want.append((row["k"], *[row[h] or None if h in head else None for h in ("note", "n", "two\nlines")], name))
                if i % 50 == 7:
                    f.write(end)
    table = SR.read_csv_text(spark, str(tmp_path), named=True)
    got = [tuple(c or None for c in r) for r in table.select("k", "note", "n", "`two\nlines`", "file").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_cell_without_an_end_is_an_error(spark, tmp_path, small_blocks):
    write(tmp_path, "a.csv", "k,n\n" + "x,1\n" * 40 + '"y,2\n' + "x,1\n" * 40)
    with pytest.raises(ContractError, match="no end"):
        SR.read_csv_text(spark, str(tmp_path))


def test_problems_have_line_numbers(spark, tmp_path, small_blocks):
    write(tmp_path, "v.jsonl", "".join('{"key":"r"}\n' if i % 7 else '\n{"kez":"r"}\n' for i in range(100)))
    scan = SR.read_jsonl(spark, str(tmp_path / "v.jsonl"), "key STRING")
    want = [i + 1 for i, line in enumerate((tmp_path / "v.jsonl").read_text().split("\n")) if "kez" in line]
    assert sorted(r["line"] for r in scan.problems.collect()) == want


def test_log_order_survives_many_rows_in_a_task(spark, tmp_path):
    n = 2_000_000
    status = F.when(F.col("id") >= n - 5, "ok").otherwise("decode_error")
    log = spark.range(n, numPartitions=1).select(
        F.concat(F.lit("u/"), (F.col("id") % 5).cast("string")).alias("key"), F.lit(None).cast("string").alias("compression"),
        status.alias("status"), F.lit(None).cast("string").alias("reason"),
    )
    path = str(tmp_path / "log")
    for batch in (0, 1):
        SR.append_outcomes(log, path, batch)
    SR.append_outcomes(log, path, 1)  # a batch again, after a failure
    rows = SR.read_outcomes(spark, path)
    seq = rows.agg(F.count("seq"), F.count_distinct("seq"), F.max("seq")).first()
    assert tuple(seq) == (2 * n, 2 * n, 2 * n - 1)
    assert {(r["key"], r["status"]) for r in logs.latest(rows).collect()} == {(f"u/{i}", "ok") for i in range(5)}


def test_log_order_survives_many_tasks_and_small_blocks(spark, tmp_path, small_blocks):
    path = str(tmp_path / "log")
    for batch in range(3):
        rows = spark.range(60, numPartitions=20).select(F.lit("k").alias("key"), F.lit(None).cast("string").alias("compression"), (F.col("id") + batch * 60).cast("string").alias("status"), F.lit(None).cast("string").alias("reason"))
        SR.append_outcomes(rows, path, batch)
    rows = SR.read_outcomes(spark, path)
    assert sorted((r["seq"], int(r["status"])) for r in rows.collect()) == [(i, i) for i in range(180)]
    # names of tasks beyond five digits, as other writers leave them
    (tmp_path / "many").mkdir()
    for task in (99_999, 100_000, 3):
        write(tmp_path / "many", f"part-{task:05d}-x-c000.txt", json.dumps({"key": "a", "compression": None, "status": str(task)}) + "\n")
    assert logs.latest(SR.read_outcomes(spark, str(tmp_path / "many"))).first()["status"] == "100000"
    assert SR.read_outcomes(spark, str(tmp_path / "many")).schema.names == [f.name for f in spark.createDataFrame([], SR.OUTCOME_SCHEMA).schema.fields if f.name != "seq"] + ["seq", "shard"]
