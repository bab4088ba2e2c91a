"""Publishers' split lists and side metadata, read into (id, split) and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions.keys import stem_of
from scoreloom.sources.records import read_csv_text


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents; a published list is one JSON document of bounded size."""
    return spark.read.option("wholetext", True).text(path)


def _split_of(rows: DataFrame) -> Column:
    """The split a list is for: the partition column it was written under, else its file's name."""
    return F.col("split") if "split" in rows.columns else stem_of(F.col("_metadata.file_name"))


def json_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """`<split>.json` files: lists of ids, or of lists of ids, all belonging to the split."""
    docs = _texts(spark, path)
    docs = docs.select(_split_of(docs).alias("split"), "value")
    items = docs.select("split", F.explode(F.from_json("value", "array<string>")).alias("item"))
    ids = F.when(
        F.startswith("item", F.lit("[")), F.from_json("item", "array<string>")
    ).otherwise(F.array("item"))
    return items.select(F.explode(ids).alias("id"), "split").distinct()


def json_pair_lists(spark: SparkSession, path: str) -> DataFrame:
    """`<split>.json` files of [source, target] pairs, with each pair's place in its list."""
    docs = _texts(spark, path)
    docs = docs.select(_split_of(docs).alias("split"), "value")
    pairs = docs.select("split", F.posexplode(F.from_json("value", "array<array<string>>")).alias("place", "p"))
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return pairs.select(
        rank.alias("list_rank"), "place", F.get("p", 0).alias("source"), F.get("p", 1).alias("target")
    )


def json_object_stems(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """A JSON object keyed by file name: the stems as test, or each with its entry's `field`."""
    entry = "map<string,string>" if field is None else f"map<string,struct<`{field}`:string>>"
    items = _texts(spark, path).select(F.explode(F.from_json("value", entry)).alias("name", "v"))
    split = F.lit("test") if field is None else F.lower(F.trim(F.col(f"v.{field}")))
    return items.select(stem_of(F.col("name")).alias("id"), split.alias("split")).distinct()


def json_split_object(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object from split to its list of ids."""
    items = _texts(spark, path).select(
        F.explode(F.from_json("value", "map<string,array<string>>")).alias("split", "ids")
    )
    return items.select(F.explode("ids").alias("id"), "split").distinct()


def source_split_object(spark: SparkSession, path: str) -> DataFrame:
    """{Train|Val|Test: {source: [file names]}} as (source, id, split)."""
    shape = "map<string,map<string,array<string>>>"
    blocks = _texts(spark, path).select(F.explode(F.from_json("value", shape)).alias("block", "m"))
    sources = blocks.select(F.lower("block").alias("split"), F.explode("m").alias("source", "names"))
    names = sources.select("source", "split", F.explode("names").alias("name"))
    return names.select("source", stem_of(F.col("name")).alias("id"), "split")


def text_lists(spark: SparkSession, path: str) -> DataFrame:
    """`<split>` text files of one id per line."""
    lines = spark.read.text(path)
    lines = lines.select(F.trim("value").alias("id"), _split_of(lines).alias("split"))
    return lines.where(F.col("id") != "").distinct()


def path_lists(spark: SparkSession, path: str) -> DataFrame:
    """`<split>` text files of .../<folder>/<file> lines, as `<folder>__<stem>` ids."""
    lines = text_lists(spark, path)
    folder = F.element_at(F.split("id", "/"), -2)
    folder = F.when(F.size(F.split("id", "/")) >= 2, F.nullif(folder, F.lit("")))
    return lines.select(F.concat_ws("__", folder, stem_of(F.col("id"))).alias("id"), "split").distinct()


def labelled_test_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines `<label> <path>`: every named stem is test."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    named = lines.where(F.instr("line", " ") > 0)
    rest = F.trim(F.expr("substr(line, instr(line, ' ') + 1)"))
    return named.select(stem_of(rest).alias("id"), F.lit("test").alias("split")).distinct()


def csv_split_definition(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of identity and split, one row per person."""
    rows = read_csv_text(spark, path)
    split = F.lower(F.trim("split"))
    return rows.select(F.trim("identity").alias("id"), split.alias("split")).where(
        split.isin("train", "val", "test")
    ).distinct()


def latest_by_stem(rows: DataFrame, name: str, line: str = "line") -> DataFrame:
    """Metadata keyed by a file name's stem; the later of two rows counts."""
    others = [c for c in rows.columns if c not in (name, line)]
    keyed = rows.select(stem_of(F.col(name)).alias("stem"), line, F.struct(*others).alias("r"))
    return keyed.groupBy("stem").agg(F.max_by("r", line).alias("r")).select("stem", "r.*")
