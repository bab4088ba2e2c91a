"""Reading and writing record lists, split lists, score tables and logs as files."""

from __future__ import annotations

import csv
import json
from functools import reduce
from operator import or_
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.errors import ContractError
from scoreloom.functions.keys import has_absolute_path, portable_text
from scoreloom.functions.scores import row_problems
from scoreloom.operators.fingerprint import fingerprint, json_line, split_line
from scoreloom.operators.records import SPLITS, require_empty
from scoreloom.session import materialized
from scoreloom.sources.lines import block_starts, numbered_log, read_lines, read_records, with_line_numbers

# Schemas as DDL texts: they are parsed only when a session is there to parse them.
VIDEO_SCHEMA = (
    "key STRING, compression STRING, label_key STRING, method STRING, identity STRING,"
    " source_id STRING, target_id STRING, pair_key STRING, attrs MAP<STRING, STRING>"
)
PAIR_SCHEMA = ("fake_key STRING, real_key STRING, rule STRING")
INVENTORY_SCHEMA = (
    "key STRING, compression STRING, label_key STRING, method STRING, relpath STRING,"
    " builder STRUCT<id: STRING, version: STRING>, identity STRING, source_id STRING,"
    " target_id STRING, pair_key STRING, attrs MAP<STRING, STRING>,"
    " probe STRUCT<frames: INT, fps: DOUBLE, width: INT, height: INT, duration_s: DOUBLE,"
    " has_audio: BOOLEAN, codec: STRING>, folder STRING"
)
OUTCOME_SCHEMA = (
    "key STRING, compression STRING, status STRING, n_frames INT, frame_indices ARRAY<INT>,"
    " relpath STRING, track STRUCT<mean_confidence: DOUBLE, identity_switch: BOOLEAN>,"
    " reason STRING, batch_id LONG, seq LONG"
)
META_SCHEMA = (
    "schema_version STRING, detector STRUCT<name: STRING, version: STRING, source: STRING,"
    " checkpoint_sha256: STRING>, protocol STRUCT<id: STRING, split: STRING,"
    " `where`: MAP<STRING, ARRAY<STRING>>, pack: STRING, pack_version: STRING,"
    " scheme_sha256: STRING>, labels STRING, processing_profile STRUCT<id: STRING, sha256: STRING>,"
    " aggregation STRUCT<clip_to_video: STRING, clips_per_video: INT>,"
    " coverage STRUCT<expected: LONG, ok: LONG, missing: LONG, error: LONG>, seed LONG,"
    " env MAP<STRING, STRING>, command STRING, created TIMESTAMP,"
    " calibration STRUCT<method: STRING, fit_file_sha256: STRING, params: MAP<STRING, STRING>>"
)

REQUIRED = ("dataset", "key", "compression", "label", "score", "status")
OPTIONAL = {"logit": "double", "label_key": "string", "method": "string", "n_clips": "int", "n_frames": "int"}


@dataclass(frozen=True)
class Scan:
    """A table read from files, and the rows of the files that break its contract."""

    rows: DataFrame
    problems: DataFrame

    def checked(self) -> DataFrame:
        """The rows, after making sure that there is no problem."""
        require_empty(self.problems, "bad input")
        return self.rows


def read_jsonl(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str | T.StructType,
    *,
    strict: bool = False,
    required: Sequence[str] = (),
) -> Scan:
    """JSON lines (gzip by suffix): blank lines skipped, other fields and broken lines reported.

    With `strict`, values of another type are reported too; fields that are `required` must be there
    and not null. Each problem has its file, the number of its line in it and the line's text.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    lines = read_lines(spark, path)
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", full, options))
    names = F.json_object_keys("value")
    known = F.array(*[F.lit(f) for f in schema.names])
    problem = F.when(names.isNull(), F.lit("not a JSON object")).when(
        F.size(F.array_except(names, known)) > 0,
        F.concat(F.lit("unknown field "), F.get(F.array_except(names, known), 0)),
    )
    for field in required:
        problem = problem.when(F.col(f"r.`{field}`").isNull(), F.lit(f"missing field {field}"))
    if strict:
        problem = problem.when(F.col("r._corrupt").isNotNull(), F.lit("value of another type"))
    bad = parsed.withColumn("problem", problem).where(F.col("problem").isNotNull())
    return Scan(
        parsed.select(*[F.col(f"r.`{f}`").alias(f) for f in schema.names]),
        with_line_numbers(bad, block_starts(lines)).select("file", "line", F.col("value").alias("text"), "problem"),
    )


def path_leaks(rows: DataFrame) -> DataFrame:
    """Rows holding an absolute path in any string, however deep."""
    leaks = F.lit(False)
    for field in rows.schema.fields:
        leaks = leaks | F.coalesce(_any_leak(F.col(field.name), field.dataType), F.lit(False))
    return rows.where(leaks)


def _any_leak(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return has_absolute_path(value)
    if isinstance(kind, T.StructType):
        out = F.lit(False)
        for f in kind.fields:
            out = out | F.coalesce(_any_leak(value[f.name], f.dataType), F.lit(False))
        return out
    if isinstance(kind, T.ArrayType):
        return F.exists(value, lambda v: F.coalesce(_any_leak(v, kind.elementType), F.lit(False)))
    if isinstance(kind, T.MapType):
        return F.exists(
            F.map_values(value), lambda v: F.coalesce(_any_leak(v, kind.valueType), F.lit(False))
        )
    return F.lit(False)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """Canonical gzip JSON lines in line order; refuses rows with absolute paths.

    Spark commits the folder when every task is done, so a failed write leaves no list behind.
    """
    require_empty(path_leaks(rows), "absolute path")
    lines = rows.select(json_line(rows.columns).alias("value")).orderBy("value")
    lines.write.mode("overwrite").option("compression", "gzip").text(path)


def read_split_tsv(spark: SparkSession, path: str) -> Scan:
    """Split lists `key, compression, split`, tab separated, no header; empty compression is null."""
    rows = (
        spark.read.schema("key STRING, compression STRING, split STRING")
        .option("sep", "\t")
        .option("quote", "")
        .option("nullValue", "")
        .csv(path)
    )
    bad = F.col("key").isNull() | ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    return Scan(rows, rows.where(bad))


def write_split_tsv(rows: DataFrame, path: str) -> str:
    """Write a split list in line order and return its fingerprint."""
    odd = F.col("key").rlike("[\t\n]") | F.coalesce(F.col("compression").rlike("[\t\n]"), F.lit(False))
    require_empty(rows.where(odd), "tab or newline in a key")
    require_empty(rows.where(~F.col("split").isin(*SPLITS)), "unknown split")
    lines = rows.select(split_line().alias("value")).orderBy("value")
    lines.write.mode("overwrite").option("compression", "gzip").text(path)
    return fingerprint(rows, split_line()).first()["fingerprint"]


def read_csv_text(spark: SparkSession, path: str, sep: str = ",", *, named: bool = False) -> DataFrame:
    """A CSV table with a header, every cell as text, a byte-order mark tolerated.

    Cells in quotes may hold line breaks, wherever Spark cuts a file into blocks. Files may order or
    choose their columns each in their own way: records are parsed by the header of their file, and
    the tables of all headers united by name. With `named`, `file` names the file of each row.
    """
    records = read_records(spark, path)
    first = records.groupBy("file").agg(F.min("line").alias("first"))
    heads = records.join(F.broadcast(first), "file").where("line = first").select("file", F.col("value").alias("head"), "first")
    # one row per file, sent to the records: dealing them by file would put a large file in one task
    body = records.join(F.broadcast(heads), "file").where("line > first")
    kinds = [r["head"] for r in heads.select("head").distinct().orderBy("head").collect()]  # one per set of columns
    if not kinds:
        raise ContractError(f"no table with a header at {path}")
    out = None
    for head in kinds:
        names = next(csv.reader([head.lstrip("\ufeff")], delimiter=sep))
        names = [n or f"_c{i}" for i, n in enumerate(names)]
        schema = ", ".join("`" + n.replace("`", "``") + "` STRING" for n in names)
        cells = F.from_csv("value", F.lit(schema), {"sep": sep, "escape": '"', "multiLine": "true"})
        rows = body.where(F.col("head") == head).select(cells.alias("r"), "name")
        table = rows.select("r.*", *([F.col("name").alias("file")] if named else []))
        out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return out


def score_table(cells: DataFrame) -> Scan:
    """A score table from text cells: typed columns, `x_*` columns folded to a map, rows checked."""
    missing = [c for c in REQUIRED if c not in cells.columns]
    if missing:
        raise ContractError(f"score table has no column {missing[0]!r}")
    extras = [c for c in cells.columns if c.startswith("x_")]
    known = {*REQUIRED, *OPTIONAL, *extras, "file"}
    strange = [c for c in cells.columns if c not in known]
    if strange:
        raise ContractError(f"score table has an unknown column {strange[0]!r}")
    cell = {c: F.nullif(F.col(f"`{c}`"), F.lit("")) for c in cells.columns}
    pairs = [F.struct(F.lit(c), cell[c]) for c in extras]
    x = F.map_from_entries(F.array(*pairs)) if pairs else F.create_map().cast("map<string,string>")
    typed = cells.select(
        *([F.col("file")] if "file" in cells.columns else []),
        cell["dataset"].alias("dataset"),
        cell["key"].alias("key"),
        cell["compression"].alias("compression"),
        cell["label"].try_cast("int").alias("label"),
        cell["score"].try_cast("double").alias("score"),
        cell["status"].alias("status"),
        *[
            (cell[c].try_cast(t) if c in cells.columns else F.lit(None).cast(t)).alias(c)
            for c, t in OPTIONAL.items()
        ],
        F.when(F.size(x) > 0, F.map_filter(x, lambda k, v: v.isNotNull())).otherwise(x).alias("x"),
    )
    each = F.explode(F.array_compact(F.array(*row_problems()))).alias("problem")
    return Scan(typed, typed.select("dataset", "key", "compression", each))


def read_scores(spark: SparkSession, path: str) -> Scan:
    """Score tables from CSV files with a header; `file` names the file of each row."""
    return score_table(read_csv_text(spark, path, named=True))


def decimal_text(value: Column) -> Column:
    """A double as its shortest decimal text, scientific only below 1e-4 (as `1e-05`)."""
    text = value.cast("string")
    shape = r"^(-?)(\d)\.(\d+)E-(\d+)$"
    sign, lead = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
    rest = F.regexp_replace(F.regexp_extract(text, shape, 3), "^0$", "")
    power = F.nullif(F.regexp_extract(text, shape, 4), F.lit(""))
    plain = F.concat(sign, F.lit("0.000"), lead, rest)
    tail = F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit(""))
    science = F.concat(sign, lead, tail, F.lit("e-"), F.lpad(power, 2, "0"))
    return F.when(power.isNull(), text).when(power == "4", plain).otherwise(science)


def score_cells(rows: DataFrame) -> DataFrame:
    """A score table as text cells: required, present optional, then sorted `x_*` columns."""
    names = []
    if "x" in rows.columns:
        found = rows.select(F.explode(F.map_keys("x")).alias("n")).distinct().orderBy("n")
        names = [r["n"] for r in found.collect()]  # column names of one table
    cells = []
    for c in [*REQUIRED, *[o for o in OPTIONAL if o in rows.columns]]:
        double = dict(rows.dtypes)[c] == "double"
        cells.append((decimal_text(F.col(c)) if double else F.col(c).cast("string")).alias(c))
    return rows.select(*cells, *[F.element_at("x", F.lit(n)).alias(n) for n in names])


def write_scores(rows: DataFrame, path: str, meta: Mapping[str, object]) -> None:
    """A score table as CSV, its meta document beside it, written last. Rows are computed once, then
    checked and written from the shared folder."""
    rows = materialized(rows, "rows")
    each = F.explode(F.array_compact(F.array(*row_problems()))).alias("problem")
    require_empty(rows.select("dataset", "key", each), "bad score row")
    table = score_cells(rows)
    broken = reduce(or_, [F.coalesce(F.col(f"`{c}`").rlike("[\r\n]"), F.lit(False)) for c in table.columns])
    # a table is read in blocks of lines, so no cell may hold a line break
    require_empty(table.where(broken), "line break in a cell")
    cells = table.write.mode("overwrite").option("header", True)
    cells.option("escape", '"').csv(path)
    spark = rows.sparkSession
    text = json.dumps(dict(meta), sort_keys=True, default=str)
    document = spark.createDataFrame([(text,)], "value string")
    document.coalesce(1).write.mode("overwrite").text(f"{path}.meta")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Meta documents, one row per file."""
    return (
        spark.read.schema(META_SCHEMA)
        .option("multiLine", True)
        .json(path)
        .withColumn("file", F.col("_metadata.file_name"))
    )


def coverage_problems(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Files whose recorded coverage differs from their rows'."""
    from scoreloom.operators.coverage import coverage

    found = coverage(rows, ["file"]).drop("coverage")
    both = meta.select("file", F.col("coverage").alias("recorded")).join(found, "file")
    same = F.lit(True)
    for c in ("expected", "ok", "missing", "error"):
        same = same & F.col(f"recorded.{c}").eqNullSafe(F.col(c))
    return both.where(~same)


# Fixed value: how a shard's outcome file is named.
SHARD_FILE = r"index\.shard-(\d+)-of-(\d+)\.jsonl"


def append_outcomes(outcomes: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch of outcomes to a log, reasons cut to portable texts, each row with its batch.

    A batch is a folder of its own, so one that is appended again takes the place of its first try.
    Rows keep the order of the table; `read_outcomes` numbers them.
    """
    rows = outcomes.withColumns(
        {
            "reason": portable_text(F.col("reason")),
            "batch_id": F.lit(batch_id).cast("long"),
        }
    )
    require_empty(path_leaks(rows), "absolute path")
    lines = rows.select(json_line(rows.columns).alias("value"))
    lines.write.mode("overwrite").text(f"{path}/batch-{batch_id:019d}")


def read_outcomes(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Outcome rows in log order by `seq`, with the shard their file names, if any.

    A later line of a log has a greater `seq`, a later batch greater ones than all before, however
    many lines, tasks and batches there are. A log whose every line holds a `seq` keeps these.
    """
    lines = read_lines(spark, path).withColumn("r", F.from_json("value", OUTCOME_SCHEMA))
    rows = numbered_log(lines, batch=F.col("r.batch_id"), own=F.col("r.seq"))
    shard = F.regexp_extract("file", SHARD_FILE, 1)
    names = [f.name for f in T.StructType.fromDDL(OUTCOME_SCHEMA) if f.name != "seq"]
    return rows.select(*[f"r.{c}" for c in names], "seq", F.nullif(shard, F.lit("")).cast("int").alias("shard"))


def list_media(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    """Paths below a folder that end in a suffix, in any case, with no hidden name on the way.

    Only names and lengths are read. A folder that is missing has no files.
    """
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "relpath string, length long")
    base = root.rstrip("/") + "/"
    relpath = F.substring_index("path", base, -1)
    named = files.select(relpath.alias("relpath"), "length")
    pattern = rf"(?i)\.({'|'.join(s.lstrip('.') for s in suffixes)})$"
    return named.where(F.col("relpath").rlike(pattern) & ~F.col("relpath").rlike(r"(^|/)\."))


def folders_with_media(listing: DataFrame, folders: Sequence[str]) -> DataFrame:
    """Which folders hold a file of the listing, as (folder, present)."""
    parent = F.regexp_replace("relpath", "/[^/]*$", "")
    held = listing.select(parent.alias("folder")).distinct().withColumn("present", F.lit(True))
    asked = listing.sparkSession.createDataFrame([(f,) for f in folders], "folder string")
    return asked.join(held, "folder", "left").select(
        "folder", F.coalesce("present", F.lit(False)).alias("present")
    )


def _documents(spark: SparkSession, root: str, name: str, schema: str, up: int = 1) -> DataFrame:
    """JSON documents of one file name below a folder, keyed by the run folder that holds them."""
    rows = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .json(root)
    )
    run = F.regexp_replace(F.col("_metadata.file_path"), "(/[^/]*){%d}$" % up, "")
    return rows.withColumn("run", run)


def runs_of(env: DataFrame, metrics: DataFrame, resume: DataFrame) -> DataFrame:
    """Training runs from their documents, each keyed by `run`, a folder path.

    Metrics make a run completed, else its resume state tells how far it came.
    """
    m = metrics.select("run", F.struct("seed", "epochs", "monitor").alias("m"))
    s = resume.select("run", F.struct("seed", "epoch").alias("s"))
    runs = env.join(m, "run", "full_outer").join(s, "run", "full_outer")
    done = F.col("m").isNotNull()
    return runs.select(
        F.element_at(F.split("run", "/"), -2).alias("name"),
        F.element_at(F.split("run", "/"), -1).alias("run"),
        F.coalesce("seed", "m.seed", "s.seed").alias("seed"),
        "created",
        F.when(done, "completed").otherwise("incomplete").alias("status"),
        F.when(done, F.col("m.epochs")).otherwise(F.col("s.epoch")).alias("epochs"),
        F.when(done, F.col("m.monitor")).alias("monitor"),
    )


_ENV = "seed LONG, created STRING"
_METRICS = "seed LONG, epochs LONG, monitor STRUCT<key: STRING, best: DOUBLE, mode: STRING>"
_RESUME = "seed LONG, epoch LONG"


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Training runs below a folder: name, seed, creation, status, epochs, what was monitored."""
    return runs_of(
        _documents(spark, root, "env.json", _ENV),
        _documents(spark, root, "metrics.json", _METRICS),
        _documents(spark, root, "state.json", _RESUME, up=2),
    )


_SOURCE = (
    "ARRAY<STRUCT<name: STRING, protocol: STRUCT<ref: STRING, split: STRING>, index: STRUCT<"
    "sources: ARRAY<STRUCT<counts: STRUCT<in_split: LONG, included: LONG>>>>>>"
)


def run_data(spark: SparkSession, root: str) -> DataFrame:
    """One row per training and validation source of every run, with its counts."""
    docs = _documents(spark, root, "data.json", f"train {_SOURCE}, val {_SOURCE}")
    parts = []
    for role in ("train", "val"):
        each = docs.select("run", F.explode(role).alias("s"))
        counts = F.get(F.col("s.index.sources"), 0)["counts"]
        parts.append(
            each.select(
                "run", F.lit(role).alias("role"), F.col("s.name").alias("name"),
                F.col("s.protocol.ref").alias("protocol"), F.col("s.protocol.split").alias("split"),
                counts["in_split"].alias("in_split"), counts["included"].alias("included"),
            )
        )
    return parts[0].unionByName(parts[1])


def best_epochs(history: DataFrame, by: Sequence[str], *, mode: str = "max") -> DataFrame:
    """The epoch with the best value per run and metric; the earliest of equals."""
    value = F.col("value") if mode == "max" else -F.col("value")
    order = F.struct(value, -F.col("epoch"))
    return history.where(F.col("value").isNotNull()).groupBy(*by).agg(
        F.max_by("epoch", order).alias("epoch"), F.max_by("value", order).alias("value")
    )
