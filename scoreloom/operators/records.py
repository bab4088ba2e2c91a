"""Reading a benchmark: which videos a scheme assigns, filtered, labelled and made portable."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError, ContractError
from scoreloom.functions.keys import task_or_key
from scoreloom.operators.ordered import join_null_safe

# The splits, and the fields of a record.
SPLITS = ("train", "val", "test", "exclude")
RECORD_FIELDS = (
    "key",
    "compression",
    "label_key",
    "method",
    "identity",
    "source_id",
    "target_id",
    "pair_key",
)
LOCAL_COLUMNS = ("relpath", "builder", "probe", "folder")
KEY = ("key", "compression")


def where_condition(where: Mapping[str, object]) -> Column:
    """A filter: a scalar means equality (None matches null), a list or set means membership."""

    def one(field: str, value: object) -> Column:
        if field == "task":
            actual = task_or_key(F.col("key"))
        elif field.startswith("attrs."):
            actual = F.element_at(F.col("attrs"), F.lit(field.removeprefix("attrs.")))
        else:
            actual = F.col(field)
        if isinstance(value, (list, tuple, set, frozenset)):
            members = [v for v in value if v is not None]
            hit = F.coalesce(actual.isin(members), F.lit(False)) if members else F.lit(False)
            return hit | actual.isNull() if None in value else hit
        return actual.eqNullSafe(F.lit(value))

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in where.items()], F.lit(True))


def check_where(videos: DataFrame, where: Mapping[str, object]) -> DataFrame:
    """The `attrs` names a filter asks for that no row has, each with the nearest existing name.

    An unknown plain field is an error at once.
    """
    known = {*RECORD_FIELDS, "task"}
    for field in where:
        if field not in known and not field.startswith("attrs."):
            raise ConfigError(f"unknown field {field!r}; known: {', '.join(sorted(known))}, attrs.*")
    asked = [f.removeprefix("attrs.") for f in where if f.startswith("attrs.")]
    wanted = F.explode(F.array(*[F.lit(a) for a in asked]).cast("array<string>"))
    present = videos.select(F.explode(F.map_keys("attrs")).alias("name")).distinct()
    pairs = present.select(wanted.alias("wanted"), "name")
    near = F.min(F.struct(F.levenshtein("wanted", "name").alias("distance"), "name"))
    found = pairs.groupBy("wanted").agg(near["distance"].alias("_d"), near["name"].alias("nearest"))
    return found.where(F.col("_d") > 0).drop("_d")


def records(
    videos: DataFrame,
    splits: DataFrame,
    *,
    split: str | Sequence[str] | None = None,
    where: Mapping[str, object] | None = None,
    keys: Sequence[str] = KEY,
) -> DataFrame:
    """Videos the scheme assigns, narrowed by split and filter, with their split.

    Both filters reach the scans; a video without a split row is absent.
    """
    wanted = splits
    if split is not None:
        names = [split] if isinstance(split, str) else list(split)
        for name in names:
            if name not in SPLITS:
                raise ConfigError(f"unknown split {name!r}; known: {', '.join(SPLITS)}")
        wanted = splits.where(F.col("split").isin(names))
    rows = videos.where(where_condition(where or {}))
    return join_null_safe(rows, wanted.select(*keys, "split"), keys)


def label_table(
    vocab: DataFrame, attribute: str, overrides: Mapping[str, int | str] | None = None
) -> DataFrame:
    """label_key with the value a mapping gives it: an override, else the vocabulary attribute."""
    value = F.col(attribute).cast("string")
    for key, override in (overrides or {}).items():
        value = F.when(F.col("label_key") == key, F.lit(str(override))).otherwise(value)
    return vocab.select("label_key", value.alias("mapped"))


def with_labels(rows: DataFrame, mapping: DataFrame, name: str = "mapped") -> DataFrame:
    """Rows with their mapped label; an unmapped key has null, which `unmapped` lists.

    The vocabulary has one row per method of a dataset.
    """
    table = mapping.select("label_key", F.col("mapped").alias(name))
    return rows.join(table, "label_key", "left")


def unmapped(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    return rows.select("label_key").distinct().join(mapping, "label_key", "left_anti")


def require_empty(problems: DataFrame, what: str) -> None:
    """Raise with one example when a check found anything."""
    found = problems.head(1)
    if found:
        raise ContractError(f"{what}: {found[0].asDict()}")


def portable(rows: DataFrame, local_attrs: Sequence[str] = ()) -> DataFrame:
    """Inventory rows without what describes the local copy."""
    out = rows.drop(*LOCAL_COLUMNS)
    if "attrs" in out.columns and local_attrs:
        names = F.array(*[F.lit(a) for a in local_attrs])
        out = out.withColumn(
            "attrs", F.map_filter("attrs", lambda k, v: ~F.array_contains(names, k))
        )
    return out


def release_rows(rows: DataFrame, compressions: Sequence[str]) -> DataFrame:
    """Rows of a listed compression or of none."""
    c = F.col("compression")
    return rows.where(c.isNull() | c.isin(list(compressions)))


def canonical_where(where: Column) -> Column:
    """An order-free text of a filter held as a map from field to values."""
    sorted_values = F.transform_values(where, lambda k, v: F.array_sort(v))
    return F.to_json(F.array_sort(F.map_entries(sorted_values)))
