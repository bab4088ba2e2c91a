"""Two-level ordered operators against plain windows and numpy, with blocks forced."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreloom.operators import ordered as O


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # one group holds a third of the rows, and one score most of that group's
    data = []
    for i in range(3000):
        g = None if i % 3 == 0 else f"g{rng.randrange(40)}"
        s = 0.5 if rng.random() < 0.4 else round(rng.random(), 3)
        data.append((g, f"k{rng.randrange(10**6):06d}-{i}", s, rng.randrange(5)))
    return spark.createDataFrame(data, "g string, key string, s double, w int").cache()


def test_crowded_scores_are_many_even_blocks(spark):
    """All scores within 0.0002: the blocks are even, never fall, and hold equal scores together."""
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("a", float(0.4999 + 0.0002 * x)) for x in rng.random(6000)] + [("b", 0.5)] * 50 + [(None, 0.1)], "g string, s double")
    got = O.with_quantile_block(df, ["g"], "s")
    of_a = got.where("g = 'a'").orderBy("s").select("s", "_block").collect()
    blocks = [r["_block"] for r in of_a]
    sizes = np.bincount(blocks)
    assert blocks == sorted(blocks) and len(set(blocks)) > 200 and sizes.max() < 3 * 6000 / 256
    assert got.groupBy("g", "s").agg(F.count_distinct("_block").alias("n")).where("n > 1").count() == 0
    assert got.where("g = 'b'").select("_block").distinct().count() == 1 and got.count() == 6051


@pytest.mark.parametrize("blocks", [1, 7, 60])
def test_numbered_equals_row_number(rows, blocks):
    got = O.numbered(rows, ["g"], ["s", "key"], "rn", blocks=blocks)
    want = rows.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("s", "key")).cast("long"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_numbered_without_groups(rows):
    got = O.numbered(rows, [], ["key"], "rn", blocks=9).select("key", "rn").collect()
    assert sorted(r.rn for r in got) == list(range(1, 3001))
    assert [r.key for r in sorted(got, key=lambda r: r.rn)] == sorted(r.key for r in got)


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_equal_window(rows, descending):
    hist = rows.groupBy("g", "s").agg(F.sum("w").alias("w"))
    got = O.prefix_sums(hist, ["g"], ["s"], {"c": F.col("w")}, descending=descending, totals={"c": "t"})
    order = F.desc("s") if descending else F.asc("s")
    w = Window.partitionBy("g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    want = hist.withColumn("c", F.sum("w").over(w)).withColumn("t", F.sum("w").over(Window.partitionBy("g")))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_quantiles_equal_numpy(rows):
    hist = rows.groupBy("g", "s").agg(F.count("*").alias("w"))
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}
    got = {r["g"]: r for r in O.weighted_quantiles(hist, ["g"], "s", "w", probs).collect()}
    data = rows.toPandas()
    for g, part in data.groupby("g", dropna=False):
        key = None if g is None or g != g else g
        for name, q in probs.items():
            assert got[key][name] == pytest.approx(np.quantile(part["s"], q), abs=1e-12)


def test_null_safe_join_kinds(spark):
    a = spark.createDataFrame([("x", None, 1), ("y", "c", 2), ("z", "c", 3)], "k string, c string, v int")
    b = spark.createDataFrame([("x", None, 10), ("y", "d", 20)], "k string, c string, u int")
    inner = O.join_null_safe(a, b, ["k", "c"]).collect()
    assert [tuple(r) for r in inner] == [("x", None, 1, 10)]
    full = {tuple(r) for r in O.join_null_safe(a, b, ["k", "c"], "full_outer").collect()}
    assert full == {("x", None, 1, 10), ("y", "c", 2, None), ("z", "c", 3, None), ("y", "d", None, 20)}
    anti = [tuple(r) for r in O.join_null_safe(a, b, ["k", "c"], "left_anti").orderBy("k").collect()]
    assert anti == [("y", "c", 2), ("z", "c", 3)]



def test_running_sums_read_the_input_once(spark, sf):
    """Both levels share the histogram's exchange, so the rows are scanned once."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet")
    hist = items.groupBy("l_returnflag", "l_discount").agg(F.sum("l_quantity").alias("w"))
    run = O.prefix_sums(
        hist, ["l_returnflag"], ["l_discount"], {"c": F.col("w")}
    )
    run.collect()
    plan = run._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("FileScan") == 1
    assert "PushedFilters" in final and "l_comment" not in final
