"""Stratified bootstrap intervals from histograms.

Drawing n rows of a class with replacement and counting them per cell of a histogram is one multinomial
draw over the cells, so replicates never touch rows and every class keeps its size.

Cells are ranked in the metric's order and cut into ranges of a fixed number of ranks, ranges into
ranges of ranges. A multinomial splits down this tree exactly. A task that works on a range draws its
way down from the top, the same numbers as every other task: a node's stream is named by the seed, the
group, the replicate and the node. So it knows what was drawn before its range and in it, and hands on
the few numbers per replicate that the range adds to the metric; cells never leave it. A group's
interval is the same alone and beside others, in any partitioning, and there is one plan for every size.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError
from scoreloom.functions.keys import hash_pick
from scoreloom.functions.range_metrics import METRICS, Range, inner_quantiles
from scoreloom.operators import metrics as M
from scoreloom.operators.ordered import join_null_safe, numbered, prefix_sums
from scoreloom.session import materialized

# Cells of a range, and ranges below a node. Draws depend on it, so it is no tuning knob.
FANOUT = 4096
# Doubles a task works on at once.
_CHUNK = 4_000_000
# Cells have counts of fakes and reals; in confidence order, of each the right and the wrong ones.
SCORE_KINDS, CONFIDENCE_KINDS = [[0], [1]], [[0, 1], [2, 3]]


def score_cells(hist: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Cells of a histogram by rank from the top score down: groups, _rank from 0, s, w0, w1."""
    run = prefix_sums(hist, groups, ["score"], {"_rank": F.lit(1)}, descending=True)
    return run.select(
        *groups, (F.col("_rank") - 1).alias("_rank"), F.col("score").cast("double").alias("s"),
        F.col("pos").cast("long").alias("w0"), F.col("neg").cast("long").alias("w1"),
    )


def confidence_cells(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Rows by rank from the most confident one down, ties in key order: each a cell of one count."""
    ordered, order = M.by_confidence(rows, groups)
    run = prefix_sums(ordered, groups, order, {"_rank": F.lit(1)}, ranges=True)
    kinds = [((F.col("_y") == y) & (F.col("_err") == e)).cast("long") for y in (1, 0) for e in (0, 1)]
    return run.select(
        *groups, (F.col("_rank") - 1).alias("_rank"), F.col("_less").alias("s"),
        *[k.alias(f"w{i}") for i, k in enumerate(kinds)],
    )


def range_tree(cells: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, int]:
    """One row per range of cells, with the totals of its siblings and of the nodes above; and their number."""
    kinds = [c for c in cells.columns if c.startswith("w")]
    listed = F.array_sort(F.collect_list(F.struct(*[c for c in cells.columns if c not in groups])))
    ranges = (
        cells.groupBy(*groups, F.floor(F.col("_rank") / FANOUT).alias("_range"))
        .agg(listed.alias("_cells"), *[F.sum(k).alias(k) for k in kinds])
        .withColumn("_node", F.floor(F.col("_range") / FANOUT))
    )
    ranges = materialized(ranges, "ranges")
    totals = [F.sum(k).alias(k) for k in kinds]
    siblings = ranges.groupBy(*groups, "_node").agg(
        F.array_sort(F.collect_list(F.struct("_range", *kinds))).alias("_siblings"), *totals
    )
    top = siblings.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("_node", *kinds))).alias("_top"))
    out = join_null_safe(ranges.drop(*kinds), siblings.drop(*kinds), [*groups, "_node"])
    out = join_null_safe(out, top, groups) if groups else out.join(F.broadcast(top))  # one row
    return out, ranges.count()


def group_stream(key: Sequence[object]) -> int:
    """What names a group's streams: its own values only."""
    return zlib.crc32(repr(tuple(map(str, key))).encode())


def _drawn(rng: np.random.Generator, n: int, weights: np.ndarray) -> np.ndarray:
    total = weights.sum()
    return rng.multinomial(n, weights / total) if n else np.zeros(len(weights), np.int64)


class RangeDraws:
    """Resamples of one range of cells, read from a row of `range_tree`."""

    def __init__(self, table: pa.Table, kinds: list[list[int]], s: str = "s"):
        names = [f"w{k}" for ks in kinds for k in ks]
        part = lambda c: table.column(c).combine_chunks()[0].values
        matrix = lambda a: np.stack([a.field(n).to_numpy() for n in names], axis=1)
        self.kinds = kinds
        self.node, self.range = (table.column(c)[0].as_py() for c in ("_node", "_range"))
        top, siblings, cells = (part(c) for c in ("_top", "_siblings", "_cells"))
        self.top, self.at_top = matrix(top), int(np.flatnonzero(top.field("_node").to_numpy() == self.node)[0])
        self.siblings = matrix(siblings)
        self.at = int(np.flatnonzero(siblings.field("_range").to_numpy() == self.range)[0])
        self.cells, self.s = matrix(cells), cells.field(s).to_numpy()
        self.sizes = self.top.sum(axis=0)

    def runs(self) -> None:
        """Neighbouring cells of one value and kind become one: rows that are alike keep their place."""
        kind = self.cells.argmax(axis=1)
        first = np.flatnonzero(np.r_[True, (np.diff(self.s) != 0) | (np.diff(kind) != 0)])
        self.cells, self.s = np.add.reduceat(self.cells, first, axis=0), self.s[first]

    def __call__(self, seed: int, stream: int, reps: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Counts by (replicate, cell, kind), and what was drawn before the range by (replicate, kind)."""
        counts = np.zeros((len(reps), *self.cells.shape), np.int64)
        before = np.zeros((len(reps), self.cells.shape[1]), np.int64)
        for i, rep in enumerate(reps):
            key = [seed, stream, rep]
            top, node, low = (np.random.default_rng([*key, *at]) for at in ((2,), (1, self.node), (0, self.range)))
            for kinds in self.kinds:
                whole = self.top[:, kinds]
                shares = _drawn(top, int(whole.sum()), whole.ravel()).reshape(whole.shape)
                for column, k in enumerate(kinds):
                    share = shares[:, column]
                    parts = _drawn(node, int(share[self.at_top]), self.siblings[:, k])
                    before[i, k] = share[: self.at_top].sum() + parts[: self.at].sum()
                    counts[i, :, k] = _drawn(low, int(parts[self.at]), self.cells[:, k])
        return counts, before


def _score_range(draws: RangeDraws, counts: np.ndarray, before: np.ndarray) -> Range:
    n_p, n_q = map(int, draws.sizes)
    none = np.zeros(len(counts))
    return Range(draws.s, counts[:, :, 0], counts[:, :, 1], before[:, 0], before[:, 1], none, n_p, n_q)


def _confidence_range(draws: RangeDraws, counts: np.ndarray, before: np.ndarray) -> Range:
    wrong = (draws.cells[:, [1, 3]].sum(axis=1) > 0).astype(float)
    p, q = counts[:, :, :2].sum(axis=2), counts[:, :, 2:].sum(axis=2)
    n_p, n_q = int(draws.sizes[:2].sum()), int(draws.sizes[2:].sum())
    return Range(wrong, p, q, before[:, :2].sum(axis=1), before[:, 2:].sum(axis=1), before[:, [1, 3]].sum(axis=1), n_p, n_q)


def slices_for(spark, ranges: int, n_boot: int) -> int:
    """Into how many shares the replicates of a range are cut, so that few ranges keep all cores busy."""
    return max(1, min(n_boot // 8, 64, -(-2 * spark.sparkContext.defaultParallelism // max(1, ranges))))


def in_slices(rows: DataFrame, slices: int) -> DataFrame:
    return rows.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))


def parts_schema(df: DataFrame, keys: Sequence[str], width: int) -> str:
    types = dict(df.dtypes)
    return ", ".join([*[f"`{c}` {types[c]}" for c in keys], "rep long", *[f"c{i} double" for i in range(width)]])


def parts_table(table: pa.Table, keys: Sequence[str], reps: Sequence[int], parts: Sequence[np.ndarray]) -> pa.Table:
    """A task's parts, one row per replicate; what is not a number is null."""
    n = len(reps)
    columns = [pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in keys]
    columns.append(pa.array(reps, pa.int64()))
    columns += [pa.array(np.asarray(p, float), pa.float64(), from_pandas=True) for p in parts]
    return pa.table(columns, names=[*keys, "rep", *[f"c{i}" for i in range(len(parts))]])


def merged(parts: DataFrame, keys: Sequence[str], name: str, params: dict) -> DataFrame:
    """(keys, rep, value) from the parts of all ranges."""
    how, width = METRICS[name], METRICS[name].width(params)
    merge = {"sum": F.sum, "max": F.max, "min": F.min}[how.merge]
    one = parts.groupBy(*keys, "rep").agg(*[merge(f"c{i}").alias(f"c{i}") for i in range(width)])
    return one.select(*keys, "rep", how.value([F.col(f"c{i}") for i in range(width)], params).alias("value"))


def _parts(
    tree: DataFrame, groups: list[str], name: str, params: dict, n_boot: int, seed: int, slices: int, edges: bool = False
) -> DataFrame:
    part, width = METRICS[name].part, METRICS[name].width(params)
    in_order = name == "aurc"
    kinds = CONFIDENCE_KINDS if in_order else SCORE_KINDS
    view = _confidence_range if in_order else _score_range

    def measure(table: pa.Table) -> pa.Table:
        draws = RangeDraws(table, kinds)
        if in_order:
            draws.runs()
        stream = group_stream([table.column(c)[0].as_py() for c in groups])
        reps = list(range(table.column("_slice")[0].as_py(), n_boot, slices))
        bounds = np.array(table.column("_edges")[0].as_py()) if edges else None
        step = max(1, _CHUNK // max(1, draws.cells.size))
        out = []
        for at in range(0, len(reps), step):
            some = reps[at : at + step]
            own = {"edges": bounds[some]} if edges else {}
            out.append(part(view(draws, *draws(seed, stream, some)), **params, **own))
        return parts_table(table, groups, reps, [np.concatenate(p) for p in zip(*out)])

    rows = in_slices(tree, slices)
    schema = parts_schema(tree, groups, width)
    return rows.groupBy(*groups, "_range", "_slice").applyInArrow(measure, schema)


def bin_edges(parts: DataFrame, hist: DataFrame, groups: list[str], bins: int) -> DataFrame:
    """The inner edges of equal-count bins of every replicate, as one list of lists per group."""
    size = hist.groupBy(*groups).agg((F.sum("pos") + F.sum("neg")).alias("_n"))
    width = 2 * (bins - 1)
    one = parts.groupBy(*groups, "rep").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(width)])
    joined = join_null_safe(one, size, groups) if groups else one.join(F.broadcast(size))

    def edge(i: int, q: float) -> Column:
        at = F.lit(q) * (F.col("_n") - 1)
        low, high = F.col(f"c{2 * i}"), F.col(f"c{2 * i + 1}")
        return low + (high - low) * (at - F.floor(at))

    each = F.array(*[edge(i, float(q)) for i, q in enumerate(inner_quantiles(bins))])
    listed = F.array_sort(F.collect_list(F.struct("rep", each.alias("e"))))
    return joined.groupBy(*groups).agg(F.transform(listed, lambda r: r["e"]).alias("_edges"))


def both_classes(hist: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The groups that hold fakes and reals."""
    sums = hist.groupBy(*groups).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    return sums.where((F.col("_p") > 0) & (F.col("_q") > 0)).select(*groups)


def replicate_values(
    hist: DataFrame,
    groups: Sequence[str],
    name: str,
    params: dict | None = None,
    *,
    n_boot: int = 2000,
    seed: int = 0,
    rows: DataFrame | None = None,
) -> DataFrame:
    """(groups, rep, value): a metric on `n_boot` resamples of each group's histogram.

    One-class groups give no rows for metrics that need both classes. `aurc` depends on the order of
    tied rows and reads `rows`.
    """
    groups, params = list(groups), dict(params or {})
    if name not in METRICS:
        raise ConfigError(f"no bootstrap for metric {name!r}")
    if not groups:
        whole = [None if x is None else x.withColumn("_all", F.lit(0)) for x in (hist, rows)]
        return replicate_values(whole[0], ["_all"], name, params, n_boot=n_boot, seed=seed, rows=whole[1]).drop("_all")
    if name == "aurc":
        if rows is None:
            raise ConfigError("resamples of aurc need the rows, for the order of ties")
        cells = confidence_cells(rows, groups)
    else:
        if M.metric(name, **params).two_class:
            hist = join_null_safe(hist, both_classes(hist, groups), groups)
        cells = score_cells(hist, groups)
    tree, ranges = range_tree(cells, groups)
    slices = slices_for(hist.sparkSession, ranges, n_boot)
    if name == "ece":
        bins = params.get("bins", 15)
        adaptive = params.pop("adaptive", False) and bins > 1
        if adaptive:
            found = _parts(tree, groups, "order_statistics", {"bins": bins}, n_boot, seed, slices)
            edges = materialized(bin_edges(found, hist, groups, bins), "edges")
            tree = join_null_safe(tree, edges, groups)
        parts = _parts(tree, groups, name, params, n_boot, seed, slices, edges=adaptive)
    else:
        parts = _parts(tree, groups, name, params, n_boot, seed, slices)
    return merged(parts, groups, name, params)


def intervals(values: DataFrame, groups: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the replicates of each group; their number is the caller's n_boot."""
    ends = F.percentile("value", [alpha / 2, 1 - alpha / 2])
    return values.groupBy(*groups).agg(ends.alias("_e")).select(
        *groups, F.get("_e", 0).alias("ci_lo"), F.get("_e", 1).alias("ci_hi")
    )


def bootstrap_ci(
    hist: DataFrame,
    groups: Sequence[str],
    name: str,
    params: dict | None = None,
    *,
    n_boot: int = 2000,
    seed: int = 0,
    alpha: float = 0.05,
    rows: DataFrame | None = None,
) -> DataFrame:
    """The metric and its interval per group; `n_boot` 0 gives the value alone.

    Value and replicates are one statistic: `aurc` takes tied rows in key order in both.
    """
    params = dict(params or {})
    point = M.compute(rows, groups, {"value": M.metric(name, **params)}, hist=hist)
    point = point.select(*groups, "value", "undefined")
    if n_boot == 0:
        none = F.lit(None).cast("double")
        return point.withColumns({"ci_lo": none, "ci_hi": none})
    values = replicate_values(hist, groups, name, params, n_boot=n_boot, seed=seed, rows=rows)
    return join_null_safe(point, intervals(values, groups, alpha), groups, "left")


def stratified_resample(
    rows: DataFrame,
    order: Sequence[str],
    *,
    n_reps: int = 1,
    seed: int = 0,
    label: str = "label",
    blocks: int | None = None,
) -> DataFrame:
    """Rows drawn with replacement within each class, every class keeping its exact size.

    Every row is also a slot; slot k of a class takes the row a hash of (seed, replicate, class, k)
    points at. The draw joins on (class, row number), an even key.
    """
    ranked = numbered(rows, [label], order, "_rn", blocks=blocks, total="_n")
    slots = ranked.select(label, F.col("_rn").alias("slot"), "_n").withColumn(
        "rep", F.explode(F.sequence(F.lit(0), F.lit(n_reps - 1)))
    )
    text = F.concat_ws(":", F.lit(str(seed)), "rep", F.col(label), "slot")
    picks = slots.select(label, "rep", "slot", (hash_pick(text, F.col("_n")) + 1).alias("_rn"))
    return picks.join(ranked.drop("_n"), [label, "_rn"]).drop("_rn")


def seed_summary(values: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over seeds, 0 for a single one, with the per-seed values."""
    return values.groupBy(*groups).agg(
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.count(F.lit(1)).alias("n_seeds"),
        F.array_sort(F.collect_list(F.struct("seed", "value"))).alias("per_seed"),
    )
