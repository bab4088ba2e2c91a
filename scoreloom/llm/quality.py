"""Quality rules: word and line statistics, and robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.common import aside, let, query, restored_names, stored, table, WORD

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Statistics are whole multiples of 1/GRID: their sums and products are exact in any order.
GRID = 4096
#: name: (least standard deviation). A statistic that is the same for nearly every document, such as
#: the share of symbols in prose, would else have no spread and make every other value an outlier.
STATISTICS = {"word_length": 0.03, "symbols": 0.03, "capitals": 0.04, "repeats": 0.10, "dup_lines": 0.10}
P = len(STATISTICS)
#: Documents that a group needs for an estimate of its own.
LEAST = 50
#: Groups up to this many rows are sent to every task; more are joined by shuffle.
SMALL_GROUPS = 20_000


def chi_square(x: float, degrees: int) -> float:
    """The share of a chi-square variable with an odd number of degrees of freedom that is at most x."""
    total, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, degrees, 2):
        total, term = total - term, term * x / (k + 2)
    return total


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if chi_square(x, degrees) < share else (low, x)
    return low


#: Squared distance beyond which a document is rejected: one in a thousand normal ones.
CUT = chi_square_quantile(0.999, P)


def repeated_words(words: Column, n: int) -> Column:
    """Words covered by windows of `n` words that occur twice or more in the array."""

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts, lambda s, k: F.least(F.lit(n), F.coalesce(F.get(starts, k + 1) - s, F.lit(n)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def found_twice(ordered: Column) -> Column:
        same = lambda x, k: x["h"].eqNullSafe(F.get(ordered, k)["h"])
        again = F.filter(ordered, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def hashed(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, found_twice))

    def windows(w: Column) -> Column:
        h = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
        return F.when(F.size(w) < n, F.lit(0)).otherwise(let(h, hashed))

    return let(words, windows)


def with_statistics(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the
    transformed statistics f0.. as whole numbers. A null text counts as an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    counted = docs.select(
        "*",
        let(words, lambda w: F.struct(F.size(w).alias("n"), repeated_words(w, 8).alias("r"))).alias("_w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("_l"),
        without(BLANKS).cast("long").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).alias("_upper"),
    ).select(
        *docs.columns,
        F.col("_w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.d").cast("long").alias("n_dup_lines"),
        F.col("_w.r").cast("long").alias("n_repeat_words"),
        ((F.col("_w.n") < 20) | (100 * F.col("_w.r") > 30 * F.col("_w.n"))).alias("base_failed"),
        "_upper",
        F.col("_l.n").alias("_lines"),
    )
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    values = [
        F.ln(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        share("_upper", "word_chars"),
        share("n_repeat_words", "n_words"),
        share("n_dup_lines", "_lines"),
    ]
    return counted.select(
        "*", *[F.round(v * GRID).cast("long").alias(f"f{i}") for i, v in enumerate(values)]
    ).drop("_upper", "_lines")


def _group(lang: Column, source: Column) -> Column:
    return F.concat_ws("\x01", F.coalesce(lang, F.lit("\x02")), F.coalesce(source, F.lit("\x02")))


def _sent(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.count() <= SMALL_GROUPS else groups


def _distance(m: Sequence[Column], low: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky factor."""
    x = [F.col(f"f{i}") / float(GRID) - m[i] for i in range(P)]

    def solve(i: int, y: list[Column]) -> Column:
        if i == P:
            return sum((v * v for v in y[1:]), y[0] * y[0])
        value = x[i]
        for k in range(i):
            value = value - low[i, k] * y[k]
        return let(value / low[i, i], lambda v: solve(i + 1, [*y, v]))

    return solve(0, [])


def _measured(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """`rows` with their squared distance `_d2`, and its bin: 64 to a factor e, for rank cuts."""
    m = [F.col(f"_m{i}") for i in range(P)]
    low = {(i, k): F.col(f"_l{i}{k}") for i in range(P) for k in range(i + 1)}
    names = [c for c in estimates.columns if c != "_group"]
    return (
        rows.join(_sent(estimates), "_group")
        .withColumn("_d2", _distance(m, low))
        .drop(*names)
        .withColumn("_bin", F.floor(F.ln(F.col("_d2") + 1e-9) * 64))
    )


def _rank_cut(measured: DataFrame, share: float) -> DataFrame:
    """Per group the lowest bin at or below which `share` of its rows lie: counts, never a sort."""
    bins = measured.groupBy("_group", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy("_group").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("_group")
    return (
        bins.select("_group", "_bin", F.sum("_n").over(run).alias("_cum"), F.sum("_n").over(whole).alias("_all"))
        .where(F.col("_cum") >= F.ceil(F.col("_all") * share))
        .groupBy("_group")
        .agg(F.min("_bin").alias("_cut"))
    )


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of the covariance per group, from exact sums of whole numbers."""
    pairs = [(i, k) for i in range(P) for k in range(i + 1)]
    sums = rows.groupBy("_group").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(f"f{i}").alias(f"_s{i}") for i in range(P)],
        *[F.sum(F.col(f"f{i}") * F.col(f"f{k}")).alias(f"_s{i}{k}") for i, k in pairs],
    )
    floors = list(STATISTICS.values())
    g = float(GRID)
    out = sums.select(
        "_group",
        *[(F.col(f"_s{i}") / F.col("_n") / g).alias(f"_m{i}") for i in range(P)],
        *[
            ((F.col(f"_s{i}{k}") - F.col(f"_s{i}").cast("double") * F.col(f"_s{k}") / F.col("_n"))
             / F.greatest(F.col("_n") - 1, F.lit(1)) / (g * g) + F.lit(floors[i] ** 2 if i == k else 0.0)).alias(f"_c{i}{k}")
            for i, k in pairs
        ],
    )
    for i in range(P):
        for k in range(i + 1):
            value = F.col(f"_c{i}{k}")
            for j in range(k):
                value = value - F.col(f"_l{i}{j}") * F.col(f"_l{k}{j}")
            value = F.sqrt(F.greatest(value, F.lit(floors[i] ** 2 / 4))) if i == k else value / F.col(f"_l{k}{k}")
            out = out.withColumn(f"_l{i}{k}", value)
    return out.select("_group", *[f"_m{i}" for i in range(P)], *[f"_l{i}{k}" for i, k in pairs])


def _start(rows: DataFrame) -> DataFrame:
    """Median and quartile spread of each statistic per group: a start that no minority moves."""
    long = rows.select(
        "_group", F.posexplode(F.array(*[F.col(f"f{i}") for i in range(P)])).alias("_i", "_v")
    )
    counts = long.groupBy("_group", "_i", "_v").agg(F.count(F.lit(1)).alias("_n"))
    quartiles = counts.groupBy("_group", "_i").agg(F.expr("percentile(_v, array(0.25D, 0.5D, 0.75D), _n)").alias("_q"))
    q = quartiles.groupBy("_group").agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(str(i)) for i in range(P)])
    floors = list(STATISTICS.values())
    spread = lambda i: F.greatest((F.col(f"{i}")[2] - F.col(f"{i}")[0]) / (1.349 * GRID), F.lit(floors[i]))
    return q.select(
        "_group",
        *[(F.col(f"{i}")[1] / float(GRID)).alias(f"_m{i}") for i in range(P)],
        *[(spread(i) if i == k else F.lit(0.0)).alias(f"_l{i}{k}") for i in range(P) for k in range(i + 1)],
    )


def judged(docs: DataFrame, carry: Sequence[str], keep: float = 0.75, steps: int = 4) -> DataFrame:
    """The columns `carry` of `docs` with their counts, base_failed, distance and kept.

    Documents that pass the base rules are grouped by language and source (null is a value like any
    other). Each group's minimum-covariance-determinant estimate comes from concentration steps:
    starting at medians and quartiles, the `keep` share of documents nearest to the estimate give the
    next mean and covariance, `steps` times. Distances are corrected by what the nearest `keep` of a
    normal variable vary less than all of it; beyond CUT, a chi-square quantile, a document is rejected.
    Documents of groups with fewer than LEAST documents are measured together by language; if those are
    too few as well, they are kept.
    Repeated rows are judged alike; null and empty texts fail the base rules; no rows give no rows.
    """
    # what is carried must not meet the columns made here
    names = {c: f"_kept_{i}" for i, c in enumerate(carry)}
    docs = docs.select(*[F.col(f"`{c}`").alias(m) for c, m in names.items()], "text", "lang", "source")
    rows = stored(
        with_statistics(docs).select(
            *names.values(),
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            *[f"f{i}" for i in range(P)],
            _group(F.col("lang"), F.col("source")).alias("_own"),
            _group(F.col("lang"), F.lit("\x03")).alias("_pool"),
        ),
        "statistics",
    )
    good = rows.where(~F.col("base_failed")).select("_own", "_pool", *[f"f{i}" for i in range(P)])
    sizes = good.groupBy("_own", "_pool").agg(F.count(F.lit(1)).alias("_n"))
    small = F.col("_n") < LEAST
    pooled = Window.partitionBy("_pool")
    groups = stored(
        sizes.withColumn("_rest", F.sum(F.when(small, F.col("_n")).otherwise(0)).over(pooled))
        .where(~small | (F.col("_rest") >= LEAST))
        .select("_own", F.when(small, F.col("_pool")).otherwise(F.col("_own")).alias("_group")),
        "groups",
    )
    groups = _sent(groups)
    member = good.join(groups, "_own").select("_group", *[f"f{i}" for i in range(P)])
    estimates = stored(_start(member), "estimate")
    for _ in range(steps):
        measured = _measured(member, estimates)
        near = measured.join(_sent(stored(_rank_cut(measured, keep), "cut")), "_group").where(F.col("_bin") <= F.col("_cut"))
        estimates = stored(_estimate(near), "estimate")
    # the nearest `keep` of normal rows vary less than all do, by this factor
    scale = chi_square(chi_square_quantile(keep, P), P + 2) / keep
    final = groups.join(estimates, "_group")
    m = [F.col(f"_m{i}") for i in range(P)]
    low = {(i, k): F.col(f"_l{i}{k}") for i in range(P) for k in range(i + 1)}
    measured = rows.join(F.broadcast(final) if groups.count() <= SMALL_GROUPS else final, "_own", "left").withColumn(
        "distance", F.when(~F.col("base_failed") & F.col("_group").isNotNull(), _distance(m, low) * scale)
    )
    return measured.select(
        *[F.col(m).alias(c) for c, m in names.items()],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT)).alias("kept"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of `docs`. Clashing names are set aside meanwhile."""
    inner, names = aside(docs, "text", "lang", "source")
    return judged(inner, list(names.values())).where("kept").select(*restored_names(names))


@query("op10_quality_rules")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(docs, ["doc_id"])
