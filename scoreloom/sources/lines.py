"""Text files as numbered lines and as records, read in blocks by many tasks.

Spark reads a large file in blocks of lines, each in one task. What depends on the lines before is
settled in two levels: per block, and over one row per block. No file is read by one task for it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.errors import ContractError
from scoreloom.operators.records import require_empty
from scoreloom.session import materialized

_BEFORE = (Window.unboundedPreceding, -1)


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines of text files, also below subfolders: value, file, name, block, at.

    `block` is where the block of the file starts that a line was read in, `at` grows from line to
    line of a block. A carriage return stays at the end of its line.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(paths)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def block_starts(lines: DataFrame) -> DataFrame:
    """Of every block: file, block, first (the least `at`), before (lines of the file before it)."""
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(*_BEFORE)
    return blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def with_line_numbers(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """Lines with `line`, their number in the file from 1 on, in place of `at`."""
    number = F.col("before") + F.col("at") - F.col("first") + 1
    return lines.join(starts, ["file", "block"]).withColumn("line", number).drop("at", "first", "before")


def _records(lines: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records and pieces of records from lines in the order of their blocks.

    Columns as of `read_records`, and `last`: null for a whole record; for a piece of a record that
    began in an earlier block or goes on in a later one, whether it is the last of the block's lines.
    """
    block, inside, parts, start = None, False, [], 0

    def out(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["value", "file", "name", "block", "line", "last"])

    for batch in lines:
        if batch["open"].isna().any():
            raise ContractError("files were cut into other blocks than when they were counted")
        rows = []
        columns = (batch[c].tolist() for c in ("value", "file", "name", "block", "line", "open"))
        for value, file, name, at, line, opened in zip(*columns):
            if block is None or block[0] != file or block[2] != at:
                if parts:
                    rows.append(("\n".join(parts), *block, start, True))
                # a piece whose record began before this block has no start of its own
                block, inside, parts, start = (file, name, at), bool(opened), [], None if opened else line
            if not parts and not inside:
                start = line
            parts.append(value)
            if value.count('"') % 2:
                inside = not inside
            if not inside:
                rows.append(("\n".join(parts), *block, line if start is None else start, None if start is not None else False))
                parts, start = [], line
        yield out(rows)
    if parts:
        yield out([("\n".join(parts), *block, start, True)])


def read_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Records of delimited files, quoted line breaks within: value, file, name, line (of its start).

    A line with an even number of quotes ends as it began, inside a quoted cell or outside. Odd lines
    are counted per block, and the parity of the blocks before says where a block begins. So records
    are put together where their lines are read; only those that lie across blocks are brought together
    from their pieces. Blank lines outside of cells are left out. A quoted cell without an end is an error.
    """
    lines = read_lines(spark, path)
    value = F.col("value")
    odd = (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(odd).alias("odd"))
    of_file = Window.partitionBy("file")
    before = of_file.orderBy("block").rowsBetween(*_BEFORE)
    # one row per block, written once: it is read again for the check of the ends
    starts = materialized(
        blocks.select(
            "file", "block", "first",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
            (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("open"),
            (F.sum("odd").over(of_file) % 2 == 1).alias("unended"),
        ),
        "blocks",
    )
    require_empty(starts.where("unended").select("file").distinct(), "a quoted cell has no end")
    line = F.col("before") + F.col("at") - F.col("first") + 1
    # sent to the lines, which keep the order they are read in
    ordered = lines.join(F.broadcast(starts), ["file", "block"], "left").select("value", "file", "name", "block", line.alias("line"), "open")
    found = ordered.mapInPandas(
        _records, "value string, file string, name string, block long, line long, last boolean"
    )
    found = materialized(found, "records")
    whole = found.where(F.col("last").isNull()).select("value", "file", "name", "line")
    # a record across blocks: its first piece ends a block, its last one begins one, blocks that lie
    # wholly inside are in between
    pieces = found.where(F.col("last").isNotNull())
    opens = F.col("last") & F.col("line").isNotNull()
    run = Window.partitionBy("file").orderBy("block", "last")
    turn = F.sum(opens.cast("int")).over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = F.array_sort(F.collect_list(F.struct("block", "value")))
    several = pieces.withColumn("_turn", turn).groupBy("file", "name", "_turn").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"), F.min_by("line", "block").alias("line")
    )
    records = whole.unionByName(several.select("value", "file", "name", "line"))
    return records.withColumn("value", F.regexp_replace("value", "\r$", "")).where(F.trim("value") != "")


def numbered_log(lines: DataFrame, *, batch: Column, own: Column) -> DataFrame:
    """Lines with `seq`, a number that grows over the whole log, in place of `at`.

    A log's files follow each other by `batch`, then by the task that wrote them, as their names say;
    lines by their place. Where every line has a number of its `own`, that one is taken. One row per
    block is ordered to count the lines before it.
    """
    blank = F.trim("value") == ""
    blocks = lines.groupBy("file", "block").agg(
        F.min("at").alias("first"),
        F.count(F.lit(1)).alias("n"),
        F.max(batch).alias("batch"),
        F.count_if(~blank & own.isNull()).alias("unnumbered"),
    )
    task = F.try_to_number(F.nullif(F.regexp_extract("file", r"part-(\d+)", 1), F.lit("")), F.lit("9999999999")).cast("long")
    order = Window.orderBy(F.asc_nulls_first("batch"), F.asc_nulls_first(task), "file", "block")
    starts = blocks.select(
        "file",
        "block",
        "first",
        F.coalesce(F.sum("n").over(order.rowsBetween(*_BEFORE)), F.lit(0)).alias("before"),
        F.sum("unnumbered").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lacking"),
    )
    place = F.col("before") + F.col("at") - F.col("first")
    seq = F.when(F.col("lacking") == 0, own).otherwise(place)
    out = lines.where(~blank).join(starts, ["file", "block"]).withColumn("seq", seq)
    return out.drop("at", "first", "before", "lacking")
