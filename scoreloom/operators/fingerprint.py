"""Order-free fingerprints of tables.

`fingerprint` is the form for tables of any size: every line is hashed where it lies, and the eight
32-bit words of the digests are summed. Equal multisets of lines give equal sums in any order and
partitioning, it is one partial aggregate with no sort, and repeated lines count. It detects
accidental change; it is not meant to resist someone who crafts collisions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_line() -> Column:
    """The canonical text of a split row: key, compression or nothing, split."""
    return F.concat_ws("\t", "key", F.coalesce("compression", F.lit("")), "split")


def json_line(columns: Sequence[str]) -> Column:
    """The canonical JSON text of a row: sorted fields, nulls kept, compact."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def fingerprint(rows: DataFrame, line: Column, by: Sequence[str] = ()) -> DataFrame:
    """Row count and fingerprint of the lines, per group."""
    digest = F.sha2(line, 256)
    word = lambda i: F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("long")
    # halves of words are summed as whole numbers: decimals would cost more than the hashing
    halves = [
        F.sum(half).alias(f"_{name}{i}")
        for i in range(8)
        for name, half in (("h", F.shiftright(word(i), 16)), ("l", word(i).bitwiseAND(65535)))
    ]
    sums = rows.select(*by, digest.alias("_d")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *halves)
    whole = lambda i: F.col(f"_h{i}").cast("decimal(20,0)") * 65536 + F.col(f"_l{i}")
    text = F.concat_ws(":", F.col("n"), *[F.coalesce(whole(i).cast("string"), F.lit("0")) for i in range(8)])
    return sums.select(*by, "n", F.sha2(text, 256).alias("fingerprint"))
