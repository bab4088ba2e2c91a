"""Joins of the evaluation workflow: split with store, inventory with release, file with file."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.keys import task_or_key
from scoreloom.operators.logs import latest
from scoreloom.operators.ordered import join_null_safe
from scoreloom.operators.records import KEY

ROW_KEY = ("dataset", "key", "compression")


def index_videos(split_videos: DataFrame, store: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every video of a split with its last outcome, its label, and why it is excluded if it is.

    Reasons in order: not processed, processing failed, excluded by the label mapping, no frames.
    The label table has one row per method.
    """
    last = latest(store).select(*KEY, F.col("status").alias("_status"), "n_frames")
    joined = join_null_safe(split_videos, last, KEY, "left").join(
        mapping.select("label_key", "mapped"), "label_key", "left"
    )
    status = F.col("_status")
    reason = (
        F.when(status.isNull(), "not-processed")
        .when(status != "ok", F.concat(F.lit("processing-failed:"), status))
        .when(F.col("mapped") == "exclude", "label-excluded")
        .when(F.col("n_frames") == 0, "no-frames")
    )
    return joined.withColumn("reason", reason).drop("_status")


def index_summary(index: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many videos each source has, keeps, and leaves out for each reason."""
    return index.groupBy(*by, F.coalesce("reason", F.lit("included")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


def verify_inventory(
    release: DataFrame,
    inventory: DataFrame,
    splits: DataFrame,
    requested: Sequence[str] | None = None,
) -> DataFrame:
    """Each key of either side with its bucket, and whether a missing one was asked for.

    Buckets: have, missing, extra, label_mismatch. `requested` defaults to every split but exclude.
    """
    a = release.select(*KEY, F.col("label_key").alias("_la"), F.col("method").alias("_ma"))
    b = inventory.select(*KEY, F.col("label_key").alias("_lb"), F.col("method").alias("_mb"))
    both = join_null_safe(a, b, KEY, "full_outer")
    split = splits.select(*KEY, F.col("split").alias("_split"))
    both = join_null_safe(both, split, KEY, "left")
    bucket = (
        F.when(F.col("_la").isNull(), "extra")
        .when(F.col("_lb").isNull(), "missing")
        .when((F.col("_la") != F.col("_lb")) | (F.col("_ma") != F.col("_mb")), "label_mismatch")
        .otherwise("have")
    )
    asked = F.col("_split").isin(list(requested)) if requested else F.col("_split") != "exclude"
    wanted = (F.col("bucket") == "missing") & F.coalesce(asked, F.lit(False))
    return both.select(*KEY, bucket.alias("bucket"), "_split").select(
        *KEY, "bucket", wanted.alias("requested")
    )


def sample_text() -> Column:
    return F.concat(F.col("key"), F.lit("|"), F.coalesce("compression", F.lit("")))


def bucket_counts(verified: DataFrame) -> DataFrame:
    """Counts of the five buckets; missing_requested is the asked-for part of missing."""
    counts = verified.agg(
        *[F.count_if(F.col("bucket") == b).alias(b) for b in ("have", "missing")],
        F.count_if("requested").alias("missing_requested"),
        *[F.count_if(F.col("bucket") == b).alias(b) for b in ("extra", "label_mismatch")],
    )
    exit_code = F.when(F.col("label_mismatch") > 0, 4).when(F.col("missing_requested") > 0, 3)
    return counts.withColumn("exit_code", F.coalesce(exit_code, F.lit(0)))


def release_warnings(verified: DataFrame, at_least: int = 10) -> DataFrame:
    """Tasks with many keys on each side only: likely another upstream release."""
    by_task = verified.groupBy(task_or_key(F.col("key")).alias("task")).agg(
        F.count_if(F.col("bucket") == "missing").alias("missing"),
        F.count_if(F.col("bucket") == "extra").alias("extra"),
    )
    return by_task.where((F.col("missing") >= at_least) & (F.col("extra") >= at_least))


def protocol_scope(split_videos: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inventory rows of a split, and the count of split videos the inventory lacks."""
    asked = split_videos.select(*KEY, "split")
    found = join_null_safe(inventory, asked, KEY)
    lacking = join_null_safe(asked, inventory.select(*KEY), KEY, "left_anti")
    return found, lacking.agg(F.count(F.lit(1)).alias("lacking"))


def relabelled(old: DataFrame, new: DataFrame, keys: Sequence[str] = ROW_KEY) -> DataFrame:
    """Videos of both releases whose label key or method changed."""
    before = old.select(*keys, F.col("label_key").alias("_l"), F.col("method").alias("_m"))
    both = join_null_safe(new.select(*keys, "label_key", "method"), before, keys)
    changed = ~F.col("label_key").eqNullSafe(F.col("_l")) | ~F.col("method").eqNullSafe(F.col("_m"))
    return both.where(changed).select(*keys)


def label_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Label mappings that changed or were added between two vocabularies.

    Inputs hold (dataset, mapping, label_key, value). A mapping changed when a shared label key
    maps elsewhere, a key was dropped, or the mapping is gone; it was added when it is new or only
    gained keys.
    """
    keys = ["dataset", "mapping", "label_key"]
    a = old.select(*keys, F.col("value").alias("_a"), F.lit(True).alias("_in_old"))
    b = new.select(*keys, F.col("value").alias("_b"), F.lit(True).alias("_in_new"))
    both = join_null_safe(a, b, keys, "full_outer")
    gone, fresh = F.col("_in_new").isNull(), F.col("_in_old").isNull()
    moved = ~gone & ~fresh & ~F.col("_a").eqNullSafe(F.col("_b"))
    per = both.groupBy("dataset", "mapping").agg(
        F.count_if(moved).alias("changed_keys"),
        F.count_if(gone).alias("dropped_keys"),
        F.count_if(fresh).alias("new_keys"),
    )
    change = F.when((F.col("changed_keys") > 0) | (F.col("dropped_keys") > 0), "changed").when(
        F.col("new_keys") > 0, "added"
    )
    return per.withColumn("change", change).where(F.col("change").isNotNull())


def missing_rows(split_videos: DataFrame, scored: DataFrame, mapping: DataFrame) -> DataFrame:
    """Score rows for the split's videos that have none, unless their label is excluded."""
    labelled = split_videos.join(mapping, "label_key").where(
        F.col("mapped") != "exclude"
    )
    unscored = join_null_safe(labelled, scored.select(*ROW_KEY), ROW_KEY, "left_anti")
    return unscored.select(
        *ROW_KEY,
        F.col("mapped").cast("int").alias("label"),
        F.lit(None).cast("double").alias("score"),
        F.lit("missing").alias("status"),
        "label_key",
        "method",
    )


def first_copy(records: DataFrame, listing: DataFrame) -> DataFrame:
    """Each record's path in the first copy that holds it; null when none does.

    `listing` has (folder, copy_index, relpath, path); a record with a folder of its own looks in
    that folder's copies, else in the dataset's.
    """
    first = listing.groupBy("folder", "relpath").agg(
        F.min_by("path", "copy_index").alias("resolved"), F.min("copy_index").alias("copy_index")
    )
    return join_null_safe(records, first, ["folder", "relpath"], "left")


def choose_copies(listing: DataFrame) -> DataFrame:
    """The first copy holding each (task, compression), and the later copies it shadows."""
    per = listing.groupBy("task", "compression").agg(
        F.min("copy_index").alias("chosen"),
        F.array_sort(F.collect_set("copy_index")).alias("_copies"),
    )
    return per.select(
        "task",
        "compression",
        "chosen",
        F.filter("_copies", lambda c: c > F.col("chosen")).alias("shadowed"),
    )


def first_match(
    entries: DataFrame, files: DataFrame, keys: Sequence[str] = ("protocol", "split", "where_key")
) -> DataFrame:
    """Suite entries with the first file that ran them, null where none did."""
    first = files.groupBy(*keys).agg(F.min("file_index").alias("file_index"))
    return join_null_safe(entries, first, keys, "left")


def parity(reported: DataFrame, measured: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Reported numbers against measured ones; a claim with no measurement is flagged."""
    keys = ["protocol", "split", "metric"]
    joined = join_null_safe(
        reported.withColumnRenamed("value", "reported"),
        measured.select(*keys, F.col("value").alias("measured")),
        keys,
        "left",
    )
    passed = F.abs(F.col("measured") - F.col("reported")) <= F.lit(tolerance)
    return joined.withColumns(
        {"passed": F.coalesce(passed, F.lit(False)), "unmeasured": F.col("measured").isNull()}
    )


POSITION_BLOCK = 4096


def _nearest_sides(
    frames: DataFrame, keys: Sequence[str], position: str, good: str
) -> DataFrame:
    """Frames with the nearest good position at or before, and at or after, each one.

    Positions are cut into fixed blocks; inside a block a running maximum finds the last good one,
    and one row per block carries it across blocks. A video of any length spreads over tasks.
    """
    by = [*keys, "_b"]
    p = F.col(position)
    hit = F.when(F.col(good), p)
    cut = frames.withColumn("_b", F.floor(p / POSITION_BLOCK))
    back = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(position).rowsBetween(0, Window.unboundedFollowing)
    inside = cut.withColumns({"_p": F.max(hit).over(back), "_n": F.min(hit).over(ahead)})
    ends = cut.groupBy(*by).agg(F.min(hit).alias("_first"), F.max(hit).alias("_last"))
    blocks = Window.partitionBy(*keys).orderBy("_b")
    carried = ends.select(
        *by,
        F.max("_last").over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias("_cp"),
        F.min("_first").over(blocks.rowsBetween(1, Window.unboundedFollowing)).alias("_cn"),
    )
    joined = join_null_safe(inside, carried, by, "left")
    return joined.withColumns(
        {"_before": F.coalesce("_p", "_cp"), "_after": F.coalesce("_n", "_cn")}
    ).drop("_p", "_n", "_cp", "_cn", "_b")


def _nearer(position: Column) -> Column:
    before, after = F.col("_before"), F.col("_after")
    closer = F.when(position - before <= after - position, before).otherwise(after)
    return F.when(before.isNull(), after).when(after.isNull(), before).otherwise(closer)


def repair_frames(clip_frames: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored position that stands in for each clip position.

    A readable frame stands for itself; else the nearest readable frame of the same clip; else of
    the same video; ties go to the earlier one. Null when no frame of the video can be read.
    `stored` has (keys, position, good), `clip_frames` (keys, clip_index, position).
    """
    video = _nearest_sides(stored, keys, "position", "good")
    video = video.select(*keys, "position", "good", _nearer(F.col("position")).alias("_in_video"))
    frames = join_null_safe(clip_frames, video, [*keys, "position"])
    clip_keys = [*keys, "clip_index"]
    in_clip = _nearest_sides(
        frames.select(*clip_keys, "position", "good").distinct(), clip_keys, "position", "good"
    ).select(*clip_keys, "position", _nearer(F.col("position")).alias("_in_clip"))
    joined = join_null_safe(frames, in_clip, [*clip_keys, "position"])
    stands = F.coalesce("_in_clip", "_in_video")
    return joined.select(
        *clip_frames.columns,
        stands.alias("replacement"),
        (~F.col("good")).alias("repaired"),
    )


def shared_rows(
    a: DataFrame, b: DataFrame, score_a: str = "score", score_b: str = "score"
) -> DataFrame:
    """Ok rows of either of two score tables, side by side; scores are null where absent."""
    left = a.where(F.col("status") == "ok").select(
        *ROW_KEY, F.col("label").alias("label_a"), F.col(score_a).alias("score_a")
    )
    right = b.where(F.col("status") == "ok").select(
        *ROW_KEY, F.col("label").alias("label_b"), F.col(score_b).alias("score_b")
    )
    return join_null_safe(left, right, ROW_KEY, "full_outer")


def overlap_counts(shared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows in both tables, in one only, and shared rows whose labels disagree."""
    a, b = F.col("score_a").isNotNull(), F.col("score_b").isNotNull()
    return shared.groupBy(*by).agg(
        F.count_if(a & b).alias("n"),
        F.count_if(a & ~b).alias("only_a"),
        F.count_if(b & ~a).alias("only_b"),
        F.count_if(a & b & (F.col("label_a") != F.col("label_b"))).alias("label_conflicts"),
    )


def match_import(
    foreign: DataFrame, split_videos: DataFrame, *, use_compression: bool
) -> tuple[DataFrame, DataFrame]:
    """Foreign rows matched to split videos by key, and the rows that match none.

    The compression decides too when the caller has one, or when a key has several. `foreign` has
    `import_key`, `import_compression` and its own columns.
    """
    counts = split_videos.groupBy("key").agg(F.count(F.lit(1)).alias("_copies"))
    videos = split_videos.join(counts, "key")
    by_key = foreign.join(videos, F.col("import_key") == F.col("key"))
    exact = F.col("compression").eqNullSafe(F.col("import_compression"))
    single = F.lit(False) if use_compression else F.col("_copies") == 1
    matched = by_key.where(single | exact).drop("_copies")
    ids = matched.select("line").distinct()
    return matched, foreign.join(ids, "line", "left_anti")


def double_matched(matched: DataFrame) -> DataFrame:
    """Videos that more than one foreign row resolves to, with the first two lines."""
    per = matched.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line")
    )
    return per.where(F.col("n") > 1)


def key_hints(
    bad: DataFrame, split_videos: DataFrame, splits: DataFrame, split: str
) -> DataFrame:
    """Likely reasons for unmatched keys: (import_key, kind, suggestion).

    Kinds: extension (the key carries a file suffix), prefix (a folder the release lacks),
    task (the task prefix is missing), other-split (the key sits in another split).
    """
    keys = bad.select("import_key").distinct()
    k = F.col("import_key")
    suffix = F.regexp_extract(k, r"^(.*[^/.][^/]*)\.[^./]*$", 1)
    stemmed = keys.withColumn("_stem", suffix).where(F.col("_stem") != "")
    known = split_videos.select("key").distinct()
    by_stem = stemmed.join(known, F.col("_stem") == F.col("key")).select(
        "import_key", F.lit("extension").alias("kind"), F.col("key").alias("suggestion")
    )
    # the first listed key with a last part stands for it; keys are listed in key order
    tails = known.groupBy(F.substring_index("key", "/", -1).alias("_tail")).agg(
        F.min("key").alias("suggestion")
    )
    rest = keys.join(by_stem.select("import_key"), "import_key", "left_anti")
    by_tail = (
        rest.withColumn("_tail", F.substring_index(k, "/", -1))
        .join(tails, "_tail")
        .where(F.col("suggestion") != k)
        .select(
            "import_key",
            F.when(F.instr(k, "/") > 0, "prefix").otherwise("task").alias("kind"),
            "suggestion",
        )
    )
    elsewhere = (
        splits.where(F.col("split") != split)
        .select(F.col("key").alias("import_key"), F.col("split").alias("suggestion"))
        .distinct()
    )
    in_other = keys.join(elsewhere, "import_key").select(
        "import_key", F.lit("other-split").alias("kind"), "suggestion"
    )
    return by_stem.unionByName(by_tail).unionByName(in_other)


def required_bump(changes: Mapping[str, DataFrame]) -> str:
    """The release bump a set of differences asks for: major, minor, patch or none.

    `changes` maps a level to the rows that call for it; the highest level with a row wins.
    """
    for level in ("major", "minor", "patch"):
        rows = changes.get(level)
        if rows is not None and rows.head(1):
            return level
    return "none"
