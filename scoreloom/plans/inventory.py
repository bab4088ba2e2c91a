"""From a listing of files to an inventory of records, and to a publisher's split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError
from scoreloom.functions.keys import local_key, stem_of, task_of
from scoreloom.operators.checks import inventory_problems
from scoreloom.operators.joins import choose_copies
from scoreloom.operators.ordered import join_null_safe
from scoreloom.plans import datasets as D

TEXT_FIELDS = ("identity", "target_id", "source_id", "pair_key")


def is_video(relpath: Column) -> Column:
    """A video suffix in any case, and no hidden name anywhere on the path."""
    suffixes = "|".join(D.VIDEO_SUFFIXES)
    return relpath.rlike(rf"(?i)\.({suffixes})$") & ~relpath.rlike(r"(^|/)\.")


def _place(release: D.Release, compressions: Sequence[str] | None) -> Column:
    """The task and compression a path belongs to, null outside the release's folders.

    Folders are looked up by the path's first parts in one constant map per depth.
    """
    known = release.compressions
    for c in compressions or ():
        if c not in known:
            raise ConfigError(f"unknown compression {c!r}; known: {', '.join(known) or 'none'}")
    path = F.col("relpath")
    depth = F.size(F.split(path, "/")) - 1
    folders: dict[tuple[int, bool], list[Column]] = {}
    for t in release.tasks:
        wanted: list[str | None] = [None]
        if "{cX}" in t.folder:
            wanted = [c for c in known if compressions is None or c in compressions]
        for c in wanted:
            folder = t.folder if c is None else t.folder.replace("{cX}", c)
            values = {
                "abbr": t.abbr, "task": t.name, "kind": t.kind, "method": t.method,
                "compression": c, "dir": folder,
            }
            place = F.struct(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
            group = folders.setdefault((folder.count("/") + 1, t.recursive), [])
            group += [F.lit(folder), place]
    found = []
    for (parts, recursive), entries in folders.items():
        here = depth >= parts if recursive else depth == parts
        at = F.substring_index(path, "/", parts)
        found.append(F.when(here, F.element_at(F.create_map(*entries), at)))
    return F.coalesce(*found)


def _met(rows: DataFrame, values: DataFrame, by: list[str], other: str) -> DataFrame:
    """`rows` with the `values` of `by`, if any. Rows whose last `by` is null meet nothing; dealt by it
    they would all be one task's, so they are dealt by their `other` column."""
    length = F.length(by[-1])
    dealt = rows.withColumn("_dealt", F.coalesce(length, F.hash(other) % (1 << 16)))
    return dealt.join(values.withColumn("_dealt", length), [*by, "_dealt"], "left").drop("_dealt")


def parse_listing(
    listing: DataFrame,
    release: D.Release,
    *,
    side: DataFrame | None = None,
    side_key: Column | None = None,
    compressions: Sequence[str] | None = None,
    folders: bool = False,
) -> DataFrame:
    """Inventory records of a release from a listing with `relpath` (and `copy_index` if copied).

    `side` is metadata keyed by `side_id`, met on `side_key` (default: the file stem). Files outside
    the release's folders are left out. With `folders`, paths are frame folders, not files.
    """
    files = listing if folders else listing.where(is_video(F.col("relpath")))
    # generated, the place is looked up once a row: as a plain column it would be copied, with all it
    # is made of, into the filter and every field
    found = F.explode_outer(F.array(_place(release, compressions))).alias("_p")
    placed = files.select("*", found).where(F.col("_p").isNotNull())
    path = F.col("relpath")
    name = F.substring_index(path, "/", -1)
    rows = placed.select(
        *listing.columns,
        "_p.*",
        (name if folders else stem_of(path)).alias("stem"),
        name.alias("file_name"),
        F.expr("substr(relpath, length(_p.dir) + 2)").alias("below"),
    )
    if side is not None:
        key = F.col("stem") if side_key is None else side_key
        values = F.struct(*[c for c in side.columns if c != "side_id"]).alias("side")
        rows = _met(rows.withColumn("side_id", key), side.select("side_id", values), ["side_id"], "relpath")
    real, fake = release.real(), release.fake()
    is_real = F.col("kind") == "real"

    def pick(field: str, default: Column) -> Column:
        if field not in real and field not in fake:
            return default
        return F.when(is_real, real.get(field, default)).otherwise(fake.get(field, default))

    none = D.null()
    base = F.create_map(F.lit("task_name"), F.col("task"))
    more = pick("attrs", F.create_map().cast("map<string,string>"))
    return rows.where(F.coalesce(pick("keep", F.lit(True)), F.lit(True))).select(
        *[c for c in listing.columns if c in ("copy_index",)],
        F.concat("abbr", F.lit("/"), pick("key", F.col("stem"))).alias("key"),
        "compression",
        F.concat(F.lit(f"{release.prefix}-"), "abbr").alias("label_key"),
        F.coalesce(pick("method", none), F.col("method")).alias("method"),
        "relpath",
        *[pick(f, none).alias(f) for f in TEXT_FIELDS],
        F.map_concat(base, more).alias("attrs"),
    )


def first_copies(records: DataFrame) -> DataFrame:
    """Records of the first copy that holds each (task, compression) only."""
    keyed = records.withColumn("task", task_of(F.col("key")))
    chosen = choose_copies(keyed).select("task", "compression", F.col("chosen").alias("_first"))
    kept = join_null_safe(keyed, chosen, ["task", "compression"])
    return kept.where(F.col("copy_index") == F.col("_first")).drop("task", "_first")


def label_vocab(spark, release: D.Release) -> DataFrame:
    """The label vocabulary: one row per task with its value under every mapping."""
    rows = []
    for t in release.tasks:
        v = release.labels[t.abbr]
        rows.append(
            (release.label_key(t.abbr), v.binary, v.binary_av, v.multiclass, v.family, t.method, t.abbr)
        )
    return spark.createDataFrame(
        rows,
        "label_key string, binary int, binary_av int, multiclass int, family string, method string, task string",
    )


def problems(records: DataFrame, release: D.Release) -> DataFrame:
    vocab = label_vocab(records.sparkSession, release)
    return inventory_problems(records, vocab.select("task", "label_key"))


def inventory_counts(records: DataFrame, by: str = "task") -> DataFrame:
    """Records by task, method, label key or compression, and in all (null group)."""
    value = task_of(F.col("key")) if by == "task" else F.col(by)
    named = records.select(F.coalesce(value, F.lit("none")).alias("group"))
    counts = named.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(
        named.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total").alias("group"), "n")
    )


def candidates(release: D.Release) -> Column:
    """What a record's fake pairs with, as an array for the pairing join."""
    return release.candidates()


def with_local(records: DataFrame) -> DataFrame:
    return records.withColumn("local", local_key(F.col("key")))


def first_listed(lists: DataFrame, order: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """One split per id: the first in `order` that lists it."""
    # ranks are numbers, so that they are merged by hashing; a text would have all rows sorted
    rank = F.coalesce(*[F.when(F.col("split") == s, F.lit(i)) for i, s in enumerate(order)])
    first = lists.where(rank.isNotNull()).groupBy("id").agg(F.min(rank).alias("_r"))
    return first.select("id", F.element_at(F.array(*[F.lit(s) for s in order]), F.col("_r") + 1).alias("split"))


def official_splits(
    release: D.Release,
    records: DataFrame,
    lists: DataFrame | None = None,
) -> DataFrame:
    """(key, split) from a publisher's lists of (id, split), by the release's own rule."""
    rows = with_local(records)
    name = release.dataset
    if name == "wilddeepfake":
        out = rows.select("key", D.wild_split(F.col("local")).alias("split"))
        return out.where(F.col("split").isNotNull()).distinct()
    if name == "ffiw10k":
        named = rows.where(F.lower("relpath").endswith(".mp4")).select("local").distinct()
        prefix = F.lower(F.substring_index("local", "_", 1))
        listed = rows.join(named, "local", "left_semi").where(prefix.isin("train", "val", "test"))
        return listed.select("key", prefix.alias("split")).distinct()
    if lists is None:
        raise ConfigError(f"{name} needs the publisher's lists")
    if name == "deeperforensics":
        return _deeper_splits(rows, lists)
    if name == "talkingheadbench":
        return _driver_splits(rows, lists)
    if release.official is None:
        raise ConfigError(f"{name} has no official split")
    keyed = rows.select("key", release.official().alias("id")).distinct()
    out = keyed.join(first_listed(lists), "id").select("key", "split").distinct()
    if name.startswith("deepspeak"):
        return out.where(F.col("split") != "val")
    if name == "av-deepfake1m-pp":
        return out.where(F.col("split") == "val")
    return out


def _deeper_splits(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Fakes by their listed file name, reals by their actor's listed fakes; then by file stem."""
    strict = ("test", "val", "train")
    name = F.substring_index("relpath", "/", -1)
    bare = F.regexp_replace("id", r"\.[^.]*$", "")
    actors = lists.select(F.get(F.split(bare, "_"), 1).alias("id"), "split")
    by_actor = first_listed(actors.where(F.col("id") != ""), strict)
    by_name = first_listed(lists, strict)
    mp4 = rows.where(F.endswith("relpath", F.lit(".mp4"))).select(
        stem_of(F.col("relpath")).alias("stem"),
        F.when(task_of(F.col("key")) == "SR", F.substring_index(name, "_", 1)).alias("_actor"),
        name.alias("_name"),
    )
    real = mp4.where(F.col("_actor").isNotNull()).join(by_actor, F.col("_actor") == F.col("id"))
    fake = mp4.where(F.col("_actor").isNull()).join(by_name, F.col("_name") == F.col("id"))
    given = real.select(F.col("stem").alias("id"), "split").unionByName(
        fake.select(F.col("stem").alias("id"), "split")
    )
    keyed = rows.select("key", stem_of(F.col("relpath")).alias("id")).distinct()
    return keyed.join(first_listed(given), "id").select("key", "split").distinct()


def _driver_splits(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Reals by the list; fakes by their driver, the held-out generators always test."""
    task = task_of(F.col("key"))
    last = lists.groupBy("source", "id").agg(
        F.max_by("split", F.when(F.col("split") == "test", 2).when(F.col("split") == "val", 1).otherwise(0)).alias("_s")
    )
    source = F.coalesce(*[F.when(task == t, F.lit(f)) for t, (f, _) in D.THB_REALS.items()])
    keyed = rows.select(
        "key",
        task.alias("_task"),
        source.isNotNull().alias("_real"),
        F.coalesce(source, F.lit("CelebV-HQ")).alias("source"),
        F.when(source.isNotNull(), F.col("local")).otherwise(F.col("source_id")).alias("id"),
    ).distinct()
    joined = _met(keyed, last, ["source", "id"], "key")
    fake = F.when(F.col("_task").isin(*D.THB_HELD_OUT) | (F.col("_s") == "test"), "test").otherwise("train")
    split = F.when(F.col("_real"), F.col("_s")).otherwise(fake)
    return joined.select("key", split.alias("split")).where(F.col("split").isNotNull())


def wild_folders(listing: DataFrame) -> DataFrame:
    """Frame folders with their number of PNG frames, from a listing of frames."""
    path = F.col("relpath")
    name = F.substring_index(path, "/", -1)
    named = (F.length(name) > 4) & ~F.startswith(name, F.lit(".")) & F.endswith(F.lower(name), F.lit(".png"))
    frames = listing.where(named & F.contains(path, F.lit("/")))
    folder = F.expr("substr(relpath, 1, length(relpath) - length(substring_index(relpath, '/', -1)) - 1)")
    return frames.groupBy(folder.alias("relpath")).agg(F.count(F.lit(1)).alias("n_frames"))


def fakeavceleb_side(meta: DataFrame) -> DataFrame:
    """The metadata file as (side_id, source, target1, method, category, raw_video_stem).

    A row needs type, race, gender, source and path; the later of two rows with one key counts, by
    the `line` column.
    """
    def value(c: str) -> Column:
        v = F.trim(c)
        return F.when((v != "") & (v != "-"), v)

    def key(file_stem: Column) -> Column:
        places = [value(c) for c in ("race", "gender", "source")]
        return F.concat_ws("__", *[D.sanitised(p) for p in places], D.sanitised(file_stem))

    stem = stem_of(F.trim("path"))
    raw = F.when(value("type") != "RealVideo-RealAudio", key(F.substring_index(stem, "_", 1)))
    needed = [value(c).isNotNull() for c in ("type", "race", "gender", "source")]
    used = meta.where(needed[0] & needed[1] & needed[2] & needed[3] & (F.trim("path") != ""))
    rows = used.select(
        "line", key(stem).alias("side_id"),
        *[value(c).alias(c) for c in ("source", "target1", "method", "category")],
        raw.alias("raw_video_stem"),
    )
    others = [c for c in rows.columns if c not in ("line", "side_id")]
    last = rows.groupBy("side_id").agg(F.max_by(F.struct(*others), "line").alias("r"))
    return last.select("side_id", "r.*")


def pair_map_side(lists: DataFrame) -> DataFrame:
    """Pair lists (list_rank, place, source, target) as a two-way map; the later entry counts."""
    def stem(c: str) -> Column:
        return F.format_string("test_%08d", F.col(c).cast("long"))

    order = F.struct("list_rank", "place", "way")
    ways = F.explode(
        F.array(
            F.struct(stem("source").alias("side_id"), stem("target").alias("pair"), F.lit(0).alias("way")),
            F.struct(stem("target").alias("side_id"), stem("source").alias("pair"), F.lit(1).alias("way")),
        )
    )
    rows = lists.select("list_rank", "place", ways.alias("w")).select("list_rank", "place", "w.*")
    return rows.groupBy("side_id").agg(F.max_by("pair", order).alias("pair"))


def speaker_side(clips: DataFrame) -> DataFrame:
    """Speakers (side_id = file name) from rows (rank, place, filename, source, age, sex)."""
    source, sex = F.trim("source"), F.trim("sex")
    full = F.concat(source, F.lit("__age"), F.col("age").cast("string"), F.lit("_"), sex)
    speaker = F.when(F.col("age").isNotNull() & (sex != ""), full).otherwise(source)
    used = clips.where((F.trim("filename") != "") & (source != ""))
    rows = used.select(F.trim("filename").alias("side_id"), "rank", "place", speaker.alias("speaker"))
    return rows.groupBy("side_id").agg(F.max_by("speaker", F.struct("rank", "place")).alias("speaker"))


def annotation_side(annotations: DataFrame) -> DataFrame:
    """Annotated fakes keyed by stem: source, target, recording, engine, audio_config; last line wins."""
    def value(c: str) -> Column:
        return F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))

    rows = annotations.where(F.trim(F.col("`video-file`")) != "").select(
        F.regexp_replace(F.trim(F.col("`video-file`")), r"\.mp4$", "").alias("side_id"),
        "line",
        F.struct(
            F.lit(True).alias("listed"),
            value("identity-source").alias("source"),
            value("identity-target").alias("target"),
            value("recording-target").alias("recording"),
            value("engine").alias("engine"),
            value("audio-config").alias("audio_config"),
        ).alias("r"),
    )
    return rows.groupBy("side_id").agg(F.max_by("r", "line").alias("r")).select("side_id", "r.*")


def driver_side(lists: DataFrame) -> DataFrame:
    """Drivers by the name a fake may give them: as listed, or having lost a leading dash."""
    driver = F.col("id")
    plain = F.struct(driver.alias("side_id"), F.lit(0).alias("_w"))
    lost = F.struct(F.expr("substr(id, 2)").alias("side_id"), F.lit(1).alias("_w"))
    names = F.when(F.startswith(driver, F.lit("-")), F.array(plain, lost)).otherwise(F.array(plain))
    named = lists.where(F.col("source") == "CelebV-HQ").select(F.explode(names).alias("_n")).select("_n.*")
    # a number is merged by hashing, and the driver follows from it and the name
    best = named.groupBy("side_id").agg(F.min("_w").alias("_w"))
    return best.select("side_id", F.when(F.col("_w") == 0, F.col("side_id")).otherwise(F.concat(F.lit("-"), "side_id")).alias("driver"))


def listed_reals(lists: DataFrame) -> DataFrame:
    """TalkingHeadBench reals: one record per stem the list names, on disk or not."""
    folder = F.col("source")
    task = F.coalesce(*[F.when(folder == f, F.lit(t)) for t, (f, _) in D.THB_REALS.items()])
    videos = F.coalesce(*[F.when(folder == f, F.lit(v)) for f, v in D.THB_REALS.values()])
    stems = lists.select("source", "id").distinct()
    return stems.select(
        F.concat(task, F.lit("/"), "id").alias("key"),
        D.null().alias("compression"),
        F.concat(F.lit("THB-"), task).alias("label_key"),
        F.lit("original").alias("method"),
        F.concat(videos, F.lit("/"), "id", F.lit(".mp4")).alias("relpath"),
        F.col("id").alias("identity"), F.col("id").alias("target_id"),
        D.null().alias("source_id"), D.null().alias("pair_key"),
        folder.alias("folder"),
    )


def lavdf_side(rows: DataFrame) -> DataFrame:
    """Metadata rows keyed by stem with their task, original and attributes as text; last row wins."""
    def text(c: str) -> Column:
        return F.to_json(c) if c == "fake_periods" else F.col(c).cast("string")

    video, audio = F.col("modify_video"), F.col("modify_audio")
    task = (
        F.when(video & audio, "FVFA").when(video & ~audio, "FVRA")
        .when(~video & audio, "RVFA").when(~video & ~audio, "RVRA")
    )
    out = rows.select(
        stem_of(F.col("file")).alias("side_id"), "place",
        F.struct(
            task.alias("task"),
            F.when(F.col("original") != "", stem_of(F.col("original"))).alias("original"),
            *[text(f).alias(f) for f in D._LAV_FIELDS],
        ).alias("r"),
    )
    return out.groupBy("side_id").agg(F.max_by("r", "place").alias("r")).select("side_id", "r.*")


def lavdf_release_records(listing: DataFrame, side: DataFrame) -> DataFrame:
    """Videos left in the release's own folders, placed by their metadata; others have no task."""
    path = F.col("relpath")
    here = path.rlike(r"^\.official_files/LAV-DF/(train|dev|test)/[^/.][^/]*$")
    suffix = path.rlike(rf"(?i)\.({'|'.join(D.VIDEO_SUFFIXES)})$")
    rows = listing.where(here & suffix).withColumn("side_id", stem_of(path)).join(side, "side_id")
    known = rows.where(F.col("task").isNotNull())
    method = F.coalesce(*[F.when(F.col("task") == t.abbr, F.lit(t.method)) for t in D.LAVDF.tasks])
    return known.select(
        F.concat("task", F.lit("/"), "side_id").alias("key"),
        D.null().alias("compression"),
        F.concat(F.lit("LAVDF-"), "task").alias("label_key"),
        method.alias("method"), "relpath",
        *[D.null().alias(f) for f in ("identity", "target_id", "source_id")],
        F.col("original").alias("pair_key"),
    )


def metadata_records(rows: DataFrame, prefix: str = "") -> DataFrame:
    """AV-Deepfake1M++ records, one per metadata row; unknown corpora and tasks are flagged.

    `problem` is null for a good row.
    """
    file, original = F.col("file"), F.col("original")
    corpus = F.substring_index(file, "/", 1)
    short = F.coalesce(*[F.when(corpus == c, F.lit(s)) for c, s in D.CORPORA.items()])
    folder = F.coalesce(F.get(F.split(file, "/"), 1), F.lit(""))
    subject = F.regexp_extract(folder, r"^(subject_\d+)", 1)
    person = F.when((short == "silent") & (subject != ""), subject).otherwise(folder)
    task = F.coalesce(
        *[
            F.when((F.col("modify_type") == m) & F.col("video_model").eqNullSafe(F.lit(v)), F.lit(a))
            for (m, v), a in D.AVDF_TASKS.items()
        ]
    )
    method = F.coalesce(*[F.when(task == t.abbr, F.lit(t.method)) for t in D.AVDF.tasks])
    inside = F.substring_index(original, "/", 1).isin(*D.CORPORA)
    visually_real = task.isin("RVRA", "RVFA")
    named = F.when(original != "", original)
    relpath = F.concat(F.lit(f"{prefix}/"), file) if prefix else file
    return rows.select(
        F.concat(task, F.lit("/"), D._path_key(file)).alias("key"),
        D.null().alias("compression"),
        F.concat(F.lit("AVDF1MPP-"), task).alias("label_key"),
        method.alias("method"),
        relpath.alias("relpath"),
        F.concat(short, F.lit(":"), person).alias("identity"),
        person.alias("target_id"),
        D.null().alias("source_id"),
        F.when(inside & ~visually_real, D._path_key(original)).alias("pair_key"),
        F.when(inside & visually_real, D._path_key(original)).alias("parent_key"),
        F.when(~inside, named).alias("upstream_source"),
        F.when((corpus == "vox_celeb_2") & folder.rlike(r"^id\d{4,5}$"), folder).alias("vox2_id"),
        F.when(F.col("audio_frames") > 0, relpath).alias("audio_relpath"),
        F.when(short.isNull(), "unknown corpus").when(task.isNull(), "unknown task").alias("problem"),
    )
