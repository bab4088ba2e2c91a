"""Columns of any name beside the needed ones, and very long words and texts, in every document operator."""

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import exact, lm, mixing, ngram_join, quality, sharding, substring, toxicity, url_filter
from tests.llm.conftest import ODD, prose

NAMES = [
    "a.b", "_kept", "_n_words", "_n_removed", "_host", "_path", "_class", "_held", "_score", "_size", "_crc", "_keep_id",
    "f0", "dk", "rk", "node", "token", "spans", "_own", "_pool", "kept", "distance", "_carried_0", "_kept_0", "_row",
]
LONG = [(900, "x" * 1_000_000), (901, prose(5, 60) + " " + "y" * 1_000_000 + " " + prose(6, 60)), (902, "ab cd " * 200_000)]


@pytest.fixture(scope="module")
def docs(make):
    rows = make([(*r, "en", "s") for r in [*ODD, *LONG, *((i, prose(i, 50)) for i in range(20, 40))]])
    return rows.withColumns({c: F.lit(f"clash {c}") for c in NAMES})


def whole(out, docs, removed=()):
    """All columns of the input are there, untouched, in rows that hold what they held."""
    assert [c for c in docs.columns if c not in removed] == [c for c in out.columns if c in docs.columns and c not in removed]
    rows = out.select(*[f"`{c}`" for c in NAMES if c not in removed]).distinct().collect()
    assert [tuple(r) for r in rows] == [tuple(f"clash {c}" for c in NAMES if c not in removed)]
    return out.count()


def test_documents_keep_their_columns(docs):
    n = docs.count()
    assert whole(substring.cut_documents(docs, 20), docs) == n
    assert whole(ngram_join.one_of_each(docs), docs) == docs.select("doc_id", "text").distinct().count()
    assert 0 < whole(quality.kept_documents(docs), docs) < n
    assert whole(exact.first_of_copies(docs), docs) == docs.select(exact.without_space(F.col("text"))).distinct().count()
    assert whole(mixing.mixed(docs), docs) > 0


def test_measures_stand_beside_all_other_columns(spark, docs):
    n = docs.count()
    assert whole(substring.without_repeats(docs), docs, {"text", "_kept", "_n_words", "_n_removed"}) == n
    assert whole(sharding.sharded(docs, [1.0] * 4), docs, {"text", "_size", "_crc"}) == n
    assert whole(lm.lm_scores(docs, F.lit(False)), docs, {"text", "_held", "_score"}) == n
    labels = spark.createDataFrame([(20, 1), (21, 0), (22, 1), (23, 0)], "doc_id long, toxic int")
    assert whole(toxicity.toxic_scores(docs, labels, F.lit(True)), docs, {"text", "_score"}) == n
    carried = [c for c in NAMES if c not in ("kept", "distance")]
    assert quality.judged(docs, carried).where("`a.b` = 'clash a.b' AND f0 = 'clash f0'").count() == n
    pages = docs.select("*", F.concat(F.lit("http://h"), "doc_id", F.lit(".net/a")).alias("url"), F.col("text").alias("html"))
    carried = [c for c in NAMES if c not in ("_host", "_path", "_class")]
    out = url_filter.url_verdicts(pages, [url_filter.Rule("block", "net", "/")], carried)
    assert out.where("`a.b` = 'clash a.b'").count() == n
