"""Mixing, sharding and URL filters against plain Python."""

import zlib

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import mixing, sharding, url_filter
from scoreloom.llm.components import components
from tests.llm.conftest import ODD, prose


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Reshare the excess until nobody is above their cap."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_resharing(spark, make, seed):
    rows = [(i, prose(i + 100 * seed, 5 + (i * 37 + seed) % 60), "en", ["a", "b", "c", "d", None][(i * i + seed) % 5]) for i in range(60)]
    docs = make(rows)
    got = mixing.mixture(docs).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = targets(sizes)
    for r in got:
        assert r["_target"] == pytest.approx(want[r["source"]])
        rate = r["_target"] / sizes[r["source"]]
        assert r["_copies"] in (int(rate), int(rate) + 1) and r["_copies"] <= 2
    again = {r["doc_id"]: r["_copies"] for r in mixing.mixture(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["_copies"] for r in got}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(again.values())


def test_mix_takes_odd_rows(spark, make):
    docs = make(ODD)
    assert mixing.mixture(docs).count() == len(ODD)
    assert mixing.mixture(docs.limit(0)).count() == 0
    clash = docs.withColumn("_rate", F.lit(1)).withColumn("size", F.lit("x"))
    assert mixing.mixed(clash).columns == clash.columns


def test_mixed_words_come_near_the_target(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/documents.parquet")
    rows = mixing.mixture(docs).groupBy("source").agg(
        F.sum(F.col("_size") * F.col("_copies")).alias("taken"), F.max("_target").alias("target")
    )
    assert all(abs(r["taken"] - r["target"]) < 0.2 * r["target"] for r in rows.collect())


def test_shards_are_stable_and_gapless(spark, make):
    docs = make([(i, prose(i % 50, 6)) for i in range(2000)] + ODD)
    rows = sharding.sharded(docs, [1.0] * 8, [1.0] * 9).collect()
    assert len(rows) == 2000 + len(ODD)
    slots = {}
    for r in rows:
        slots.setdefault(r["_shard"], []).append(r["_slot"])
        assert r["_grown"] in (r["_shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r["_shard"] == r2["_shard"] for r in rows for r2 in rows if r["doc_id"] == r2["doc_id"] == 12)
    one = next(r for r in rows if r["doc_id"] == 5)
    assert one["_crc"] == zlib.crc32(prose(5, 6).encode()) and one["_size"] == len(prose(5, 6)) + 16
    assert sharding.sharded(docs.limit(0), [1.0] * 8).count() == 0


def test_weights_set_the_shares(spark, make):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r["_shard"]: r["count"] for r in sharding.sharded(docs, [1.0, 3.0]).groupBy("_shard").count().collect()}
    assert 0.73 < n[1] / 20_000 < 0.77


def test_components_equal_a_search(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (30, 31), (5, 5), (None, 4), (3, 1), *[(100, 200 + i) for i in range(50)], *[(i, i + 1) for i in range(300, 340)]]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {}
    for a, b in edges:
        if a is not None and a != b:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in want:
        for a, b in edges:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert components(spark.createDataFrame([], "src string, dst string")).count() == 0


PAGES = "page_id long, url string, html string"
LINK = '<html><head><link rel="canonical" href="{}"></head></html>'


def verdicts(spark, rows, redirects=None):
    pages = spark.createDataFrame(rows, PAGES).withColumn("_host", F.lit("clash"))
    table = None if redirects is None else spark.createDataFrame(redirects, "src_url string, dst_url string")
    out = url_filter.url_verdicts(pages.drop("_host"), url_filter.RULES, ["page_id"], table).collect()
    return {r["page_id"]: (r["_rule"], r["_verdict"]) for r in out}


def test_rules_and_aliases(spark):
    rows = [
        (1, "http://Bad.NET/x", None),
        (2, "https://a.example.net/en/1", ""),
        (3, "https://plain.com/p?q=1#f", LINK.format("http://mirror.com/1")),
        (4, "http://mirror.com/1", "<META HTTP-EQUIV='Refresh' CONTENT='0; URL=http://evil.net/z'>"),
        (5, "http://other.com/a/b", "<link href='../c' rel=canonical>"),
        (6, "http://safe.com/1", LINK.format("http://x.org/fr/1")),
        (7, "http://safe.com/2", LINK.format("/1")),
        (8, "http://safe.com/1?", LINK.format("http://evil.net/z2")),
        (9, None, LINK.format("http://evil.net/")),
        (10, "no host", LINK.format("http://evil.net/")),
        (11, "http://net", None),
        (12, "http://example.com/de/x", LINK.format("http://x.org/fr/2")),
        (13, "http://r.com/start", None),
        (1, "http://Bad.NET/x", None),
    ]
    got = verdicts(spark, rows, [("http://r.com/start", "http://r2.com/"), ("http://r2.com/", "http://w.net/"), (None, "http://w.net/")])
    assert got[1] == ("net/", "block") and got[2] == ("example.net/en/", "allow")
    assert got[3] == (None, "block") and got[4] == (None, "block")  # along two edges
    assert got[5] == (None, "allow")
    assert got[6] == (None, "allow") and got[7] == (None, "allow")  # an explicit allow in the class
    assert got[8] == (None, "block")
    assert got[9] == (None, "allow") and got[10] == (None, "allow")
    assert got[11] == (None, "allow")  # an empty path doesn't start with "/"
    assert got[12] == ("example.com/de/", "block")  # its own rule first
    assert got[13] == (None, "block")
    assert verdicts(spark, []) == {}


def test_given_pages_hold_no_aliases(spark, sf):
    """The SQL twin of op2 relies on this."""
    assert url_filter.alias_edges(spark.read.parquet(f"{sf}/pages.parquet")).count() == 0
