"""Sharding by weighted rendezvous hashing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import aside, hex_unit, query, restored_names, table

# Rows that one task orders when slots are given out.
ROWS_PER_BLOCK = 1_000_000


def key_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score -weight / ln(u) is greatest, u in (0, 1) hashed from (key, shard).

    A key's scores of the shards that stay don't change when one comes or goes: a new shard takes
    rows only into itself, a removed one gives away only its own.
    """
    def score(i: int, w: float) -> Column:
        u = hex_unit(F.md5(F.concat_ws("#", key, F.lit(str(i))).cast("binary")))
        u = (u * float(1 << 52) + 0.5) / float(1 << 52)
        return F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(-i).alias("shard"))

    return (-F.array_max(F.array(*[score(i, w) for i, w in enumerate(weights)]))["shard"]).cast("int")


def sharded(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """`docs`, but for its text, with _size, _crc, _shard, _slot and _grown (the shard under `grown` weights).

    Slots count from 0 in every shard, in the order of md5(key), crc and size. Rows are numbered in
    blocks of equal leading digits, whose totals are added up per shard: a shard is never one task,
    and the digits used grow with the number of rows without changing any slot. A null id is the key
    "null". Rows of one id share a shard; equal rows get neighbouring slots. A null text has no
    bytes and the checksum of an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    inner, names = aside(docs, "doc_id", "text")
    keyed = inner.select(
        *[m for c, m in names.items() if c != "text"],
        (F.octet_length(text) + 16).cast("long").alias("_size"),
        F.crc32(text).alias("_crc"),
        key_of(F.col("doc_id")).alias("_key"),
    )
    digits = max(1, math.ceil(math.log(max(1, docs.count() / ROWS_PER_BLOCK), 16)) + 1)
    placed = keyed.select(
        "*",
        rendezvous(F.col("_key"), weights).alias("_shard"),
        (rendezvous(F.col("_key"), grown) if grown is not None else F.lit(None).cast("int")).alias("_grown"),
        F.md5(F.concat_ws("#", "_key", F.col("_crc").cast("string"), F.col("_size").cast("string")).cast("binary")).alias("_h"),
    ).withColumn("_block", F.substring("_h", 1, digits))
    ordered = Window.partitionBy("_shard", "_block").orderBy("_h", "_key")
    totals = placed.groupBy("_shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_in", F.row_number().over(ordered) - 1)
        .join(offsets, ["_shard", "_block"])
        .withColumn("_slot", (F.col("_in") + F.col("_before")).cast("long"))
        .select(*restored_names(names, ["_size", "_crc", "_shard", "_slot", "_grown"], without=["text"]))
    )


@query("op7_rendezvous_shards")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharded(docs, [1.0] * 40, [1.0] * 41).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.col("_grown").alias("grown_shard"),
    )
