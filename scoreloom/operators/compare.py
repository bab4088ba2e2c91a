"""Paired comparison of score tables."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError, ContractError
from scoreloom.functions.range_metrics import METRICS, Range
from scoreloom.operators import bootstrap as B
from scoreloom.operators import metrics as M
from scoreloom.operators.joins import ROW_KEY
from scoreloom.operators.ordered import join_null_safe, prefix_sums
from scoreloom.operators.records import require_empty
from scoreloom.session import materialized


def file_pairs(rows: DataFrame) -> DataFrame:
    """Ok rows that two files share, for every pair of files a < b: (a, b, row key, scores, label).

    A row key meets itself once per pair of files, and the caller chose the files.
    """
    ok = rows.where(F.col("status") == "ok").select("file", *ROW_KEY, "label", "score")
    left = ok.withColumnsRenamed({"file": "a", "score": "score_a", "label": "label_a"})
    right = ok.withColumnsRenamed({"file": "b", "score": "score_b", "label": "label_b"})
    return join_null_safe(left, right, ROW_KEY).where(F.col("a") < F.col("b"))


def joint_hist(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Counts of fakes and reals per pair of scores: all a comparison needs."""
    y = F.col("label_a").cast("long")
    return pairs.groupBy(*groups, "score_a", "score_b").agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )


def side_hist(joint: DataFrame, groups: Sequence[str], side: str) -> DataFrame:
    return joint.groupBy(*groups, F.col(f"score_{side}").alias("score")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )


def _placements(joint: DataFrame, groups: Sequence[str], side: str) -> DataFrame:
    """For each score, the share of reals it beats and the share of fakes that beat it."""
    run = prefix_sums(
        side_hist(joint, groups, side),
        groups,
        ["score"],
        {"_cp": F.col("pos"), "_cn": F.col("neg")},
        totals={"_cp": "_np", "_cn": "_nn"},
    )
    reals_below = F.col("_cn") - F.col("neg") * 0.5
    fakes_above = F.col("_np") - F.col("_cp") + F.col("pos") * 0.5
    return run.select(
        *groups,
        F.col("score").alias(f"score_{side}"),
        (reals_below / F.nullif("_nn", F.lit(0))).alias(f"_x_{side}"),
        (fakes_above / F.nullif("_np", F.lit(0))).alias(f"_y_{side}"),
    )


def delong(joint: DataFrame, groups: Sequence[str]) -> DataFrame:
    """DeLong's test that two paired AUCs are equal: auc_a, auc_b, z per group.

    The test's variance is that of the difference of each row's placements, within each class, so
    one weighted pass over the joint histogram is enough. Differences that never vary have variance
    exactly zero: z is then 0 for equal AUCs and infinite otherwise. Null, with the reason, below
    two rows in a class.
    """
    keyed = joint
    for side in ("a", "b"):
        keyed = join_null_safe(keyed, _placements(joint, groups, side), [*groups, f"score_{side}"])
    dx, dy = F.col("_x_a") - F.col("_x_b"), F.col("_y_a") - F.col("_y_b")

    def spread(weight: str, d: Column, name: str) -> list[Column]:
        w = F.col(weight)
        seen = F.when(w > 0, d)
        return [
            F.sum(w * d).alias(f"_s1{name}"),
            F.sum(w * d * d).alias(f"_s2{name}"),
            (F.max(seen) - F.min(seen)).alias(f"_r{name}"),
        ]

    sums = keyed.groupBy(*groups).agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.col("pos") * F.col("_x_a")).alias("_a"),
        F.sum(F.col("pos") * F.col("_x_b")).alias("_b"),
        *spread("pos", dx, "x"),
        *spread("neg", dy, "y"),
    )

    def variance(n: str, name: str) -> Column:
        c = F.col(n)
        centred = F.col(f"_s2{name}") - F.col(f"_s1{name}") * F.col(f"_s1{name}") / c
        return F.when(F.col(f"_r{name}") == 0, 0.0).otherwise(centred / (c - 1) / c)

    enough = (F.col("n_pos") >= 2) & (F.col("n_neg") >= 2)
    a, b = F.col("_a") / F.col("n_pos"), F.col("_b") / F.col("n_pos")
    v = variance("n_pos", "x") + variance("n_neg", "y")
    gap = a - b
    inf = F.lit(float("inf"))
    z = (
        F.when(v > 0, gap / F.sqrt(v))
        .when(F.abs(gap) <= 1e-12, F.lit(0.0))
        .otherwise(F.when(gap > 0, inf).otherwise(-inf))
    )
    reason = F.when(~enough, F.lit("fewer than two rows in a class"))
    return sums.select(
        *groups,
        "n_pos",
        "n_neg",
        F.when(enough, a).alias("auc_a"),
        F.when(enough, b).alias("auc_b"),
        F.when(enough, z).alias("z"),
        reason.alias("undefined"),
    )


def with_p_value(tests: DataFrame, z: str = "z") -> DataFrame:
    """The two-sided normal p-value of `z`; one row per comparison, so a small Python helper."""

    @F.pandas_udf("double")
    def two_sided(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2.0)))

    return tests.withColumn("p", two_sided(F.col(z)))


def holm(tests: DataFrame, families: Sequence[str], p: str = "p", index: str = "i") -> DataFrame:
    """Holm's step-down adjusted p-values within each family of tests; ties by `index`."""
    ordered = Window.partitionBy(*families).orderBy(p, index)
    whole = Window.partitionBy(*families)
    m = F.count(F.lit(1)).over(whole)
    step = (m - F.row_number().over(ordered) + 1) * F.col(p)
    stepped = tests.withColumn("_step", step)
    running = F.max("_step").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), running)).drop("_step")


def _joint_cells(joint: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Cells of a joint histogram by rank, and their rank on either side: groups, _rank, _at_a, s_a, ..."""
    cells = joint.select(*groups, "score_a", "score_b", "pos", "neg")
    for side in ("a", "b"):
        score = f"score_{side}"
        run = prefix_sums(side_hist(joint, groups, side), groups, ["score"], {"_at": F.lit(1)}, descending=True)
        places = run.select(*groups, F.col("score").alias(score), (F.col("_at") - 1).alias(f"_at_{side}"))
        cells = join_null_safe(cells, places, [*groups, score])
    run = prefix_sums(cells, groups, ["_at_a", "_at_b"], {"_rank": F.lit(1)}, ranges=True)
    return run.select(
        *groups, (F.col("_rank") - 1).alias("_rank"),
        *[c for x in "ab" for c in (F.col(f"_at_{x}"), F.col(f"score_{x}").cast("double").alias(f"s_{x}"))],
        F.col("pos").cast("long").alias("w0"), F.col("neg").cast("long").alias("w1"),
    )


def _joint_rows(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Shared rows by rank, and their rank by confidence on either side; s_a and s_b are 1 where wrong."""
    rows = pairs.select(*groups, *ROW_KEY, F.col("label_a").alias("label"), "score_a", "score_b")
    out = None
    for side in ("a", "b"):
        own = rows.withColumnRenamed(f"score_{side}", "score")
        ordered, order = M.by_confidence(own, groups)
        run = prefix_sums(ordered, groups, order, {"_at": F.lit(1)}, ranges=True)
        keys = [c for c in order if c.startswith("_t_")]
        part = run.select(*groups, *keys, F.col("_y"), (F.col("_at") - 1).alias(f"_at_{side}"), F.col("_err").cast("double").alias(f"s_{side}"))
        out = part if out is None else join_null_safe(out, part.drop("_y"), [*groups, *keys])
    run = prefix_sums(out, groups, keys, {"_rank": F.lit(1)}, ranges=True)
    return run.select(
        *groups, (F.col("_rank") - 1).alias("_rank"), *[c for x in "ab" for c in (f"_at_{x}", f"s_{x}")],
        F.col("_y").cast("long").alias("w0"), (1 - F.col("_y")).cast("long").alias("w1"),
    )


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(x.astype(np.uint32).tobytes(), 1)


def _side_draws(tree: DataFrame, groups: list[str], n_boot: int, seed: int, slices: int) -> DataFrame:
    """Resampled joint cells, dealt out to the ranges of either side: counts by (replicate, cell), packed."""
    fanout = B.FANOUT
    types = dict(tree.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in groups], "_side string, _part long, _slice int, at array<long>, s array<double>, p binary, q binary"])

    def draw(table: pa.Table) -> pa.Table:
        cells = table.column("_cells").combine_chunks()[0].values
        draws = B.RangeDraws(table, B.SCORE_KINDS, s="s_a")
        stream = B.group_stream([table.column(c)[0].as_py() for c in groups])
        piece = table.column("_slice")[0].as_py()
        counts, _ = draws(seed, stream, list(range(piece, n_boot, slices)))
        out = []
        for side in ("a", "b"):
            at, score = cells.field(f"_at_{side}").to_numpy(), cells.field(f"s_{side}").to_numpy()
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            p, q = (np.add.reduceat(counts[:, order, k], first, axis=1) for k in (0, 1))
            places = at[order][first]
            for part in np.unique(places // fanout):
                here = places // fanout == part
                out.append((side, int(part), piece, places[here], score[order][first][here], _pack(p[:, here]), _pack(q[:, here])))
        columns = [pa.array([table.column(c)[0].as_py()] * len(out), table.schema.field(c).type) for c in groups]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.binary(), pa.binary()]
        columns += [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)]
        return pa.table(columns, names=[*groups, "_side", "_part", "_slice", "at", "s", "p", "q"])

    return B.in_slices(tree, slices).groupBy(*groups, "_range", "_slice").applyInArrow(draw, schema)


def _added_up(drawn: DataFrame, groups: list[str], n_boot: int, slices: int) -> DataFrame:
    """One row per range of a side: its cells' counts from all joint ranges, and their sums by replicate."""
    types = dict(drawn.dtypes)
    keys = [*groups, "_side", "_part", "_slice"]
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keys], "s array<double>, p binary, q binary, sums array<struct<rep: int, tp: long, fp: long, wrong: double>>"])

    def add(table: pa.Table) -> pa.Table:
        piece = table.column("_slice")[0].as_py()
        reps = len(range(piece, n_boot, slices))
        at = [np.asarray(x) for x in table.column("at").to_pylist()]
        places, where = np.unique(np.concatenate(at), return_inverse=True)
        s = np.zeros(len(places))
        p, q = np.zeros((reps, len(places)), np.int64), np.zeros((reps, len(places)), np.int64)
        ends = np.cumsum([len(x) for x in at])
        for i, end in enumerate(ends):
            own = where[end - len(at[i]) : end]
            s[own] = table.column("s")[i].as_py()
            for total, name in ((p, "p"), (q, "q")):
                drawn_ = np.frombuffer(zlib.decompress(table.column(name)[i].as_py()), np.uint32)
                total[:, own] += drawn_.reshape(reps, len(own))
        sums = list(zip(range(reps), p.sum(axis=1).tolist(), q.sum(axis=1).tolist(), ((p + q) * s).sum(axis=1).tolist()))
        kind = pa.list_(pa.struct([("rep", pa.int32()), ("tp", pa.int64()), ("fp", pa.int64()), ("wrong", pa.float64())]))
        columns = [pa.array([table.column(c)[0].as_py()], table.schema.field(c).type) for c in keys]
        listed = [dict(zip(("rep", "tp", "fp", "wrong"), x)) for x in sums]
        columns += [pa.array([s.tolist()]), pa.array([_pack(p)]), pa.array([_pack(q)]), pa.array([listed], kind)]
        return pa.table(columns, names=[*keys, "s", "p", "q", "sums"])

    return drawn.groupBy(*keys).applyInArrow(add, schema)


def _side_parts(ranges: DataFrame, groups: list[str], name: str, params: dict, n_boot: int, slices: int, edges: bool) -> DataFrame:
    """The parts of a metric from ranges of either side that know what was drawn before them."""
    part, width = METRICS[name].part, METRICS[name].width(params)
    keys = [*groups, "_side"]

    def measure(row: pa.Table) -> pa.Table:
        reps = list(range(row.column("_slice")[0].as_py(), n_boot, slices))
        s = np.asarray(row.column("s")[0].as_py())
        p, q = (
            np.frombuffer(zlib.decompress(row.column(c)[0].as_py()), np.uint32).reshape(len(reps), len(s)).astype(np.int64)
            for c in ("p", "q")
        )
        tp, fp, wrong = (np.asarray(row.column(c)[0].as_py(), float) for c in ("_tp", "_fp", "_wrong"))
        own = {"edges": np.array(row.column("_edges")[0].as_py())[reps]} if edges else {}
        n_p, n_q = (row.column(c)[0].as_py() for c in ("_n_pos", "_n_neg"))
        return B.parts_table(row, keys, reps, part(Range(s, p, q, tp, fp, wrong, n_p, n_q), **params, **own))

    return ranges.groupBy(*keys, "_part", "_slice").applyInArrow(measure, B.parts_schema(ranges, keys, width))


def paired_delta_ci(
    joint: DataFrame,
    groups: Sequence[str],
    name: str,
    params: dict | None = None,
    *,
    n_boot: int = 2000,
    seed: int = 0,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Interval of metric(b) - metric(a) over resamples of the shared rows.

    Both sides of a replicate see the same rows, because joint cells are what is drawn, range by range
    as in `bootstrap`. Their counts are dealt out to the ranges of either side, which learn what was
    drawn before them from the sums per range and replicate. One-class groups have no interval for
    metrics that need both classes. `aurc` depends on the order of tied rows and reads `pairs`.
    """
    groups, params = list(groups), dict(params or {})
    if not groups:
        whole = [None if x is None else x.withColumn("_all", F.lit(0)) for x in (joint, pairs)]
        return paired_delta_ci(whole[0], ["_all"], name, params, n_boot=n_boot, seed=seed, pairs=whole[1]).drop("_all")
    if name not in METRICS:
        raise ConfigError(f"no bootstrap for metric {name!r}")
    if name == "aurc" and pairs is None:
        raise ConfigError("resamples of aurc need the rows, for the order of ties")
    if M.metric(name, **params).two_class:
        joint = join_null_safe(joint, B.both_classes(joint, groups), groups)
    cells = _joint_rows(pairs, groups) if name == "aurc" else _joint_cells(joint, groups)
    tree, n_ranges = B.range_tree(cells, groups)
    slices = B.slices_for(joint.sparkSession, n_ranges, n_boot)
    sides = materialized(_added_up(_side_draws(tree, groups, n_boot, seed, slices), groups, n_boot, slices), "sides")
    keys = [*groups, "_side", "_part", "_slice"]
    each = sides.select(*keys, F.inline("sums"))
    before = Window.partitionBy(*groups, "_side", "_slice", "rep").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ["tp", "fp", "wrong"]
    offsets = each.select(*keys, "rep", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums])
    listed = offsets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rep", *sums))).alias("_o"))
    listed = listed.select(*keys, *[F.col(f"_o.{c}").cast("array<double>").alias(f"_{c}") for c in sums])
    sizes = joint.groupBy(*groups).agg(F.sum("pos").alias("_n_pos"), F.sum("neg").alias("_n_neg"))
    ranges = join_null_safe(join_null_safe(sides.drop("sums"), listed, keys), sizes, groups)
    by, adaptive = [*groups, "_side"], False
    if name == "ece":
        bins = params.get("bins", 15)
        adaptive = params.pop("adaptive", False) and bins > 1
        if adaptive:
            found = _side_parts(ranges, groups, "order_statistics", {"bins": bins}, n_boot, slices, False)
            both = joint.select(*groups, "pos", "neg", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("_side"))
            ranges = join_null_safe(ranges, materialized(B.bin_edges(found, both, by, bins), "edges"), by)
    values = B.merged(_side_parts(ranges, groups, name, params, n_boot, slices, adaptive), by, name, params)
    side = lambda x: F.max(F.when(F.col("_side") == x, F.col("value")))
    deltas = values.groupBy(*groups, "rep").agg((side("b") - side("a")).alias("value"))
    return B.intervals(deltas, groups).withColumnsRenamed({"ci_lo": "delta_lo", "ci_hi": "delta_hi"})


def compare(
    rows: DataFrame,
    metrics: dict[str, tuple[str, dict]],
    *,
    n_boot: int = 2000,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """Every pair of files on the rows both scored. Fewer than two files, a pair without a shared
    row, and rows that two files label differently are refused.

    Returns `overlap` (shared and one-sided counts, label conflicts), `metrics` (both values, their
    difference and its interval per metric) and `delong` (the AUC test, Holm-adjusted over pairs).
    """
    pairs = file_pairs(rows)
    by = ["a", "b"]
    files = [r["file"] for r in rows.select("file").distinct().orderBy("file").collect()]
    if len(files) < 2:
        raise ContractError("a comparison needs two files or more")
    require_empty(pairs.where(~F.col("label_a").eqNullSafe(F.col("label_b"))).select(*by, *ROW_KEY), "labels differ")
    met = {(r["a"], r["b"]) for r in pairs.select(*by).distinct().collect()}  # pairs of files
    for pair in itertools.combinations(files, 2):
        if pair not in met:
            raise ContractError(f"files {pair[0]!r} and {pair[1]!r} share no scored row")
    joint = joint_hist(pairs, by)
    ok = rows.where(F.col("status") == "ok").groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    overlap = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label_a") != F.col("label_b")).alias("label_conflicts"),
    )
    for side in by:
        total = ok.select(F.col("file").alias(side), F.col("_n").alias(f"_n{side}"))
        overlap = overlap.join(total, side)
    overlap = overlap.select(
        *by, "n", "label_conflicts",
        (F.col("_na") - F.col("n")).alias("only_a"), (F.col("_nb") - F.col("n")).alias("only_b"),
    )
    parts = []
    for label, (name, params) in metrics.items():
        point = None
        for side in ("a", "b"):
            own = pairs.select(*by, *ROW_KEY, F.col("label_a").alias("label"), F.col(f"score_{side}").alias("score"))
            v = M.compute(
                own, by, {f"value_{side}": M.metric(name, **params)},
                hist=side_hist(joint, by, side),
            ).select(*by, f"value_{side}")
            point = v if point is None else point.join(v, by)
        point = point.withColumn("delta", F.col("value_b") - F.col("value_a"))
        if n_boot:
            ci = paired_delta_ci(joint, by, name, params, n_boot=n_boot, seed=seed, pairs=pairs)
            point = point.join(ci, by, "left")
        else:
            none = F.lit(None).cast("double")
            point = point.withColumns({"delta_lo": none, "delta_hi": none})
        parts.append(point.withColumn("metric", F.lit(label)))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    tests = with_p_value(delong(joint, by)).withColumn("_family", F.lit(0))
    defined = tests.where(F.col("p").isNotNull()).withColumn("_i", F.struct(*by))
    adjusted = holm(defined, ["_family"], "p", "_i").select(*by, "p_holm")
    tests = tests.drop("_family").join(adjusted, by, "left")
    return {"overlap": overlap, "metrics": table, "delong": tests}
