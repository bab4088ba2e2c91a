"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import aside, hex_unit, query, restored_names, stored, table, word_count

# Sources up to this many rows are sent to every task; more are joined by shuffle.
SMALL_SOURCES = 100_000


def source_targets(
    sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code-point order (null last) weigh `weights`, repeating. Together they are to have
    `share` of all sizes; none gets more than `cap` times its own, the excess going to the others
    by weight. Resharing fills sources in order of cap * size / weight, so one ordered pass over the
    sources finds which are capped: source i is, if sharing what is left among i and all later ones
    gives i more than its cap. Sizes are whole numbers, hence their sums don't depend on any order.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    pattern = F.array(*[F.lit(int(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sums.withColumn("_w", F.element_at(pattern, ((place - 1) % len(weights) + 1).cast("int")))
    fill = [(F.lit(cap) * F.col("source_size") / F.col("_w")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*fill).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*fill).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(*fill).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(every) - F.lit(cap) * F.coalesce(
        F.sum("source_size").over(before), F.lit(0)
    )
    level = ranked.withColumn("_level", left / F.sum("_w").over(after)).withColumn(
        "_capped", F.col("_level") * F.col("_w") > F.lit(cap) * F.col("source_size")
    )
    # the level of the first source that isn't capped is the level of all later ones
    final = F.min(F.when(~F.col("_capped"), F.struct(F.lit(cap) * F.col("source_size") / F.col("_w"), F.col("_level")))).over(every)
    return level.withColumn("_final", final["_level"]).select(
        "source",
        "source_size",
        F.when(F.col("_capped"), F.lit(cap) * F.col("source_size"))
        .otherwise(F.col("_final") * F.col("_w")).cast("double").alias("target"),
    )


def mixture(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """`docs` with _size, _source_size, _target and _copies: how often the mix holds each document.

    A source's repetition rate is target / size. A document comes floor(rate) times, and once more
    if a number hashed from (seed, doc_id) is below the fraction. Null or wordless texts have size 0
    and follow their source's rate; a source of size 0 has rate 0. A null source is a source. Rows
    that share a doc_id share their draw; a null id draws as the text "null". No rows give no rows.
    """
    inner, names = aside(docs, "doc_id", "source", "text")
    sized = inner.select("*", word_count(F.col("text")).alias("_size"))
    sources = stored(
        source_targets(sized.select("source", F.col("_size").alias("size")), weights, share, cap), "sources"
    ).withColumnsRenamed({"source": "_src", "source_size": "_source_size", "target": "_target"})
    if sources.count() <= SMALL_SOURCES:
        sources = F.broadcast(sources)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    draw = hex_unit(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    copies = F.floor("_rate") + (draw < F.col("_rate") - F.floor("_rate")).cast("long")
    return (
        sized.join(sources, F.col("source").eqNullSafe(F.col("_src")))
        .withColumn("_rate", rate)
        .withColumn("_copies", copies)
        .select(*restored_names(names, ["_size", "_source_size", "_target", "_copies"]))
    )


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each document as often as `mixture` says, with the columns of `docs`."""
    inner, names = aside(docs, "doc_id", "source", "text")
    rows = mixture(inner, **options)
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select(*restored_names(names))


SIZES = f"""
sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sums),
filled AS (
  SELECT *, (1.5::DOUBLE * sum(s) OVER () - 2.0::DOUBLE * coalesce(sum(s) OVER (ORDER BY 2.0::DOUBLE * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY 2.0::DOUBLE * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
marked AS (SELECT *, level * w > 2.0::DOUBLE * s AS capped FROM filled),
targets AS (
  SELECT source, s, CASE WHEN capped THEN 2.0::DOUBLE * s
    ELSE (SELECT arg_min(level, 2.0::DOUBLE * s / w) FROM marked WHERE NOT capped) * w END AS target FROM marked),
drawn AS (
  SELECT d.doc_id, d.size, t.s, t.target, CASE WHEN t.s > 0 THEN t.target / t.s ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
"""


@query(
    "op4_source_mix",
    f"""WITH {SIZES}
SELECT doc_id, size::BIGINT AS size, s AS source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM drawn""",
)
def op4(spark, sf_dir):
    return mixture(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).cast("long").alias("taken"),
    )
