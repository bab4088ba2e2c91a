"""Exact dedup by skew-safe combining, in columns only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import aside, query, restored_names, stored, table

# A digest that this share of the rows has is salted, so at most as many digests are.
HOT_SHARE = 1000
# Code points outweigh any id in the order of a group: ids lie within 10**19 of each other's middle.
_STEP = "100000000000000000000"
_MIDDLE = "10000000000000000000"
ADDED = ["_keep_id", "_group_size", "_kept", "_digest"]


def without_space(text: Column) -> Column:
    """A text without its ASCII white space; a null one is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\v\f":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(content: Column) -> Column:
    return F.unhex(F.sha2(content.cast("binary"), 256))


def _place(chars: Column, doc_id: Column) -> Column:
    """One number that is greatest for the row that stays: most code points, then the smallest id."""
    wide = lambda c: c.cast("decimal(38,0)")
    back = F.coalesce(wide(F.lit(_MIDDLE)) - wide(doc_id), wide(F.lit(0)))
    return (wide(chars) * wide(F.lit(_STEP)) + back).cast("decimal(38,0)")


def _id_of(place: Column) -> Column:
    back = (place % F.lit(_STEP).cast("decimal(38,0)")).cast("decimal(38,0)")
    return F.when(back != 0, (F.lit(_MIDDLE).cast("decimal(38,0)") - back).cast("long"))


def exact_groups(
    docs: DataFrame, *, digest: Callable[[Column], Column] = sha256, text: bool = False
) -> DataFrame:
    """`docs`, its text only if asked for, with _keep_id, _group_size, _kept and _digest.

    Rows are equal when their texts are, white space aside; null counts as empty. Of equal rows the
    one with the most code points in its text stays, then the one of the smallest doc_id, a null id
    last. Exactly one row of a group stays, also where rows repeat with their ids: then the one with
    the smallest hash of its text, any of wholly equal ones. Texts are taken whole, however long, and
    columns of any name are carried. No rows give no rows.

    Every task first keeps one row per content it meets. Those rows meet by (digest, salt): a digest
    that holds over a thousandth of all rows has as many salts as make its shares a thousandth, others
    have one. The winners of a digest's salts then meet by digest. Both steps group by the content
    itself next to the digest. Rows find their group by (digest, salt), so a hot group is many tasks
    there too, and no text moves for it; digests with several contents are found at the first step
    and their rows find their group by content instead.
    """
    content = without_space(F.col("text"))
    inner, names = aside(docs, "doc_id", "text")
    carried = [m for c, m in names.items() if text or c != "text"]
    rows = inner.select(
        digest(content).alias("_digest"),
        _place(F.length(F.coalesce(F.col("text"), F.lit(""))), F.col("doc_id")).alias("_place"),
        F.xxhash64("text").alias("_row"),
        content.alias("_content"),
        *carried,
    )
    total = docs.count()
    counts = rows.groupBy("_digest").count().where(F.col("count") * HOT_SHARE > total)
    salts = F.ceil(F.col("count") * HOT_SHARE / max(total, 1)).cast("int")
    # under HOT_SHARE rows, whatever the corpus: their shares of all rows add up to 1 at most
    hot = F.broadcast(stored(counts.select("_digest", salts.alias("_salts")), "hot"))
    salted = rows.join(hot, "_digest", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("_place"), "_salts").cast("int"))
    best = [F.max("_place").alias("_best"), F.count(F.lit(1)).alias("_n")]
    merged = salted.groupBy("_digest", "_salt", "_salts", "_content").agg(*best)
    # where a digest has one salt, its contents are compared by now and needn't go on
    shares = stored(merged.withColumn("_content", F.when(F.col("_salts") > 1, F.col("_content"))), "shares")
    combined = shares.where("_salts > 1").groupBy("_digest", "_content").agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"))
    alone = shares.where("_salts = 1").select("_digest", "_best", "_n")
    groups = stored(combined.select("_digest", "_best", "_n").unionByName(alone), "groups")
    mixed = stored(groups.groupBy("_digest").count().where("count > 1").select("_digest"), "mixed")
    several = mixed.count() > 0
    plain = groups.join(mixed, "_digest", "left_anti") if several else groups
    found = shares.select("_digest", "_salt").distinct().join(plain, "_digest")
    out = _judged(salted.drop("_content"), found, ["_digest", "_salt"], carried)
    if several:
        texts = rows.join(mixed, "_digest", "left_semi")
        by_content = texts.groupBy("_digest", "_content").agg(*best)
        out = out.unionByName(_judged(texts, by_content, ["_digest", "_content"], carried))
    return out.select(*restored_names({c: m for c, m in names.items() if m in carried}, ADDED))


def _judged(rows: DataFrame, groups: DataFrame, by: list[str], carried: list[str]) -> DataFrame:
    """Rows with what their group says of them. Rows that could stay alike stand in one share."""
    tie = F.row_number().over(Window.partitionBy(*by, "_place").orderBy("_row"))
    return rows.join(groups, by).select(
        *carried,
        _id_of(F.col("_best")).alias("_keep_id"),
        F.col("_n").alias("_group_size"),
        ((F.col("_place") == F.col("_best")) & (tie == 1)).alias("_kept"),
        "_digest",
    )


def first_of_copies(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of `docs` that stay when each group of equal texts keeps one, as `exact_groups` says."""
    inner, names = aside(docs, "doc_id", "text")
    return exact_groups(inner, text=True, **options).where("_kept").select(*restored_names(names))


@query(
    "op11_exact_dedup",
    r"""WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER g = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t ORDER BY chars DESC, doc_id NULLS LAST)""",
)
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select(
        "doc_id",
        F.col("_keep_id").alias("keep_id"),
        F.col("_group_size").alias("group_size"),
        F.col("_kept").alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
