"""Queries: frame sampling, clips, crops, draws, batches, tracking and subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import frames as FR
from scoreloom.operators import sampling as S
from scoreloom.operators import track as T
from scoreloom.operators.ordered import numbered
from scoreloom.plans import views as V
from scoreloom.plans.catalog import query, r9
from scoreloom.plans.views import with_views

# Documents stand in for videos of n_chars frames.
N = "n_chars"


def clip_videos(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "documents").selectExpr("doc_id", f"{N} AS total", f"{N} + 1 AS stored")


_MODES = {
    "all": ({}, "unnest(range(0, t))"),
    "uniform": ({"frames": 32}, "unnest(list_distinct([CASE WHEN i = 31 THEN t - 1 ELSE CAST(floor(i * ((t - 1) / CAST(31 AS DOUBLE))) AS BIGINT) END FOR i IN range(0, 32)]))"),
    "first-consecutive": ({"frames": 100}, "unnest(range(0, least(100, t)))"),
    "stride": ({"stride": 7}, "unnest(range(0, t, 7))"),
}


@query(
    "p18_frame_sampling",
    " UNION ALL ".join(
        f"SELECT doc_id, '{m}' AS mode, CAST({sql} AS INTEGER) AS frame FROM (SELECT doc_id, {N} AS t FROM documents) WHERE t > 0"
        for m, (_, sql) in _MODES.items()
    ),
)
def p18(spark: SparkSession, d: str) -> DataFrame:
    picks = [
        F.struct(F.lit(m).alias("mode"), FR.sample_indices(m, F.col("total"), **kw).alias("frames"))
        for m, (kw, _) in _MODES.items()
    ]
    modes = clip_videos(spark, d).select("doc_id", F.explode(F.array(*picks)).alias("m"))
    return modes.select("doc_id", F.col("m.mode").alias("mode"), F.explode("m.frames").alias("frame"))


def _clip_rows(clips) -> list:
    return [
        "doc_id", F.col("c.clip_index").alias("clip_index"),
        F.array_join(F.transform("c.positions", lambda p: p.cast("string")), ",").alias("positions"),
        F.col("c.padded").alias("padded"),
    ]


@query(
    "p19_eval_clips_uniform",
    f"""SELECT doc_id, CAST(c AS INTEGER) AS clip_index, array_to_string([CASE WHEN i = 31 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / CAST(31 AS DOUBLE))) AS BIGINT) END FOR i IN range(c * 8, c * 8 + 8)], ',') AS positions, false AS padded
FROM (SELECT doc_id, {N} + 1 AS n, unnest(range(0, 4)) AS c FROM documents)""",
)
def p19(spark: SparkSession, d: str) -> DataFrame:
    clips = FR.eval_clips(F.col("stored"), frames=8, clips=4)
    return clip_videos(spark, d).select("doc_id", F.explode(clips).alias("c")).select(*_clip_rows("c"))


@query(
    "p19_eval_clips_runs",
    f"""SELECT doc_id, CAST(c AS INTEGER) AS clip_index, array_to_string([least(s + k * 3, n - 1) FOR k IN range(0, 8)], ',') AS positions, s + 21 >= n AS padded
FROM (SELECT doc_id, n, c, CASE WHEN c = 4 THEN greatest(n - 24, 0) ELSE CAST(floor(c * (greatest(n - 24, 0) / CAST(4 AS DOUBLE))) AS BIGINT) END AS s
  FROM (SELECT doc_id, {N} + 1 AS n, unnest(range(0, 5)) AS c FROM documents))""",
)
def p19_runs(spark: SparkSession, d: str) -> DataFrame:
    clips = FR.eval_clips(F.col("stored"), frames=8, clips=5, sampling="consecutive", stride=3)
    return clip_videos(spark, d).select("doc_id", F.explode(clips).alias("c")).select(*_clip_rows("c"))


# Python's generator is not SQL: checked against plain Python in the tests.
@query("p20_train_clips")
def p20(spark: SparkSession, d: str) -> DataFrame:
    rows = clip_videos(spark, d).withColumn("clip_index", F.explode(F.sequence(F.lit(0), F.lit(1))))
    rows = rows.withColumn("sample", F.col("doc_id") * 2 + F.col("clip_index"))
    out = S.train_clips(
        rows, stored="stored", sample="sample", clip="clip_index", frames=8, clips=2, seed=1, epoch=3
    )
    return out.select(
        "doc_id", "clip_index", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"), "padded"
    )


@query(
    "t15_clip_frames",
    f"""SELECT doc_id, CAST(c AS INTEGER) AS clip_index, CAST(k AS INTEGER) AS step, CAST((CASE WHEN i = 15 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / CAST(15 AS DOUBLE))) AS BIGINT) END) * 5 + 2 AS BIGINT) AS frame_number
FROM (SELECT doc_id, n, c, k, c * 8 + k AS i FROM (SELECT doc_id, {N} + 1 AS n, unnest(range(0, 2)) AS c FROM documents), (SELECT unnest(range(0, 8)) AS k))""",
)
def t15(spark: SparkSession, d: str) -> DataFrame:
    clips = FR.eval_clips(F.col("stored"), frames=8, clips=2)
    # stored frame p of a video is its source frame 5p + 2
    stored = F.transform(F.sequence(F.lit(0).cast("long"), F.col("stored") - 1), lambda p: p * 5 + 2)
    rows = clip_videos(spark, d).select("doc_id", stored.alias("s"), F.explode(clips).alias("c"))
    each = rows.select("doc_id", "s", F.col("c.clip_index").alias("clip_index"), F.posexplode("c.positions").alias("step", "p"))
    return each.select("doc_id", "clip_index", "step", F.get("s", F.col("p")).alias("frame_number"))


@query(
    "s08_frame_rows",
    f"""SELECT doc_id, CAST(unnest(range(0, least({N}, 16))) AS INTEGER) AS frame_index FROM documents WHERE {N} > 0""",
)
def s08(spark: SparkSession, d: str) -> DataFrame:
    from scoreloom.sources.tables import frame_rows

    picks = FR.sample_indices("first-consecutive", F.col("total"), frames=16)
    rows = clip_videos(spark, d).where("total > 0").withColumn("frame_indices", picks)
    out = frame_rows(rows.withColumn("clip_index", F.lit(0)), ["doc_id", "clip_index"])
    return out.select("doc_id", "frame_index")


@query(
    "f07_row_multiplying",
    f"""SELECT count(*) AS n, CAST(sum(p) AS BIGINT) AS total FROM (SELECT CASE WHEN i = 31 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / CAST(31 AS DOUBLE))) AS BIGINT) END AS p FROM (SELECT {N} + 1 AS n, unnest(range(0, 32)) AS i FROM documents))""",
)
def f07(spark: SparkSession, d: str) -> DataFrame:
    clips = FR.eval_clips(F.col("stored"), frames=8, clips=4)
    rows = clip_videos(spark, d).select(F.explode(clips).alias("c")).select(F.explode("c.positions").alias("p"))
    return rows.agg(F.count("*").alias("n"), F.sum("p").alias("total"))


BOXES = """SELECT l_orderkey, l_linenumber, l_partkey % 97 - 12.5::DOUBLE AS x1, l_suppkey % 53 - 9.25::DOUBLE AS y1, l_partkey % 97 - 12.5::DOUBLE + l_quantity * 3 - 4 AS x2,
  l_suppkey % 53 - 9.25::DOUBLE + l_partkey % 41 * 2 AS y2 FROM lineitem"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    x1, y1 = F.col("l_partkey") % 97 - F.lit(12.5), F.col("l_suppkey") % 53 - F.lit(9.25)
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.struct(
            x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_quantity") * 3 - 4).alias("x2"),
            (y1 + F.col("l_partkey") % 41 * 2).alias("y2"),
        ).alias("b"),
    )


_CROP = """SELECT l_orderkey, l_linenumber, trunc(cx - s / 2)::INTEGER AS left_, trunc(cy - s / 2)::INTEGER AS top_, trunc(cx + s / 2)::INTEGER AS right_, trunc(cy + s / 2)::INTEGER AS bottom_, s, x1, y1
  FROM (SELECT *, greatest(x2 - x1, y2 - y1) * 1.3::DOUBLE AS s, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM b)"""


@query(
    "p21_crop_boxes",
    f"""WITH b AS ({BOXES}), c AS ({_CROP}) SELECT l_orderkey, l_linenumber, left_, top_, right_, bottom_, greatest(0, -left_) AS pad_left, greatest(0, right_ - 160) AS pad_right
FROM c WHERE right_ > left_ AND bottom_ > top_""",
)
def p21(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    box = FR.crop_box(b["x1"], b["y1"], b["x2"], b["y2"], scale=1.3, width=F.lit(160), height=F.lit(120))
    rows = boxes(spark, d).withColumn("c", box).where("c IS NOT NULL")
    return rows.selectExpr(
        "l_orderkey", "l_linenumber", "c.x1 AS left_", "c.y1 AS top_", "c.x2 AS right_", "c.y2 AS bottom_", "c.pad_left", "c.pad_right"
    )


@query(
    "p22_landmarks_in_crop",
    f"""WITH b AS ({BOXES}), c AS ({_CROP}) SELECT l_orderkey, l_linenumber, round((x1 + 3 - left_) * (224 / s), 9) AS x, round((y1 + 5 - top_) * (224 / s), 9) AS y
FROM c WHERE right_ > left_ AND bottom_ > top_""",
)
def p22(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    box = FR.crop_box(b["x1"], b["y1"], b["x2"], b["y2"], scale=1.3, width=F.lit(160), height=F.lit(120))
    rows = boxes(spark, d).withColumn("c", box).where("c IS NOT NULL")
    points = F.array(F.struct((b["x1"] + 3).alias("x"), (b["y1"] + 5).alias("y")))
    p = F.get(FR.map_landmarks(points, F.col("c"), 224), 0)
    return rows.select("l_orderkey", "l_linenumber", r9(p["x"]).alias("x"), r9(p["y"]).alias("y"))


@query(
    "p23_box_overlap",
    f"""WITH b AS ({BOXES}), p AS (SELECT *, w * h AS i, (x2 - x1) * (y2 - y1) + 80 * 60 - w * h AS u FROM (
  SELECT *, greatest(0.0, least(x2, 90.0) - greatest(x1, 10.0)) AS w, greatest(0.0, least(y2, 70.0) - greatest(y1, 10.0)) AS h FROM b))
SELECT l_orderkey, l_linenumber, round((x2 - x1) * (y2 - y1), 9) AS area, round(CASE WHEN u = 0 THEN 0 ELSE i / u END, 9) + 0.0 AS iou FROM p""",
)
def p23(spark: SparkSession, d: str) -> DataFrame:
    fixed = F.struct(*[F.lit(v).alias(k) for k, v in (("x1", 10.0), ("y1", 10.0), ("x2", 90.0), ("y2", 70.0))])
    b = F.col("b")
    return boxes(spark, d).select(
        "l_orderkey", "l_linenumber", r9(FR.box_area(b)).alias("area"), r9(FR.box_iou(b, fixed)).alias("iou")
    )


def _pick(text: str, n: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT % {n}"


RN = """SELECT key, compression, label, row_number() OVER (ORDER BY key) - 1 AS slot, row_number() OVER (PARTITION BY label ORDER BY key) AS rn, count(*) OVER (PARTITION BY label) AS cnt FROM fx_videos"""


@query(
    "t10_label_balanced_draws",
    with_views(
        f"""SELECT s.slot, t.key, t.label FROM (SELECT slot, {_pick("'7:2:' || slot || ':label'", "2")} AS l FROM r) s
JOIN (SELECT DISTINCT label, cnt FROM r) c ON c.label = s.l JOIN r t ON t.label = s.l AND t.rn = {_pick("'7:2:' || s.slot || ':row'", "c.cnt")} + 1""",
        "fx_videos", r=RN,
    ),
)
def t10(spark: SparkSession, d: str) -> DataFrame:
    out = S.label_balanced_draws(V.videos(spark, d).select("key", "label"), ["key"], seed=7, epoch=2)
    return out.select("slot", "key", "label")


@query(
    "t11_source_weighted_draws",
    with_views(
        f"""SELECT s.slot, t.key, s.src AS source_id FROM (SELECT slot, CASE WHEN u < 1 / CAST(6 AS DOUBLE) THEN 0 WHEN u < 3 / CAST(6 AS DOUBLE) THEN 1 ELSE 2 END AS src FROM (
  SELECT slot, {_pick("'7:2:' || slot || ':source'", "4294967296")} / CAST(4294967296 AS DOUBLE) AS u FROM r)) s
JOIN (SELECT DISTINCT src, cnt FROM r) c ON c.src = s.src JOIN r t ON t.src = s.src AND t.rn = {_pick("'7:2:' || s.slot || ':row'", "c.cnt")} + 1""",
        "fx_videos",
        r="""SELECT key, CAST(substr(dataset, 3) AS INTEGER) AS src, row_number() OVER (ORDER BY dataset, key) - 1 AS slot, row_number() OVER (PARTITION BY dataset ORDER BY key) AS rn, count(*) OVER (PARTITION BY dataset) AS cnt FROM fx_videos""",
    ),
)
def t11(spark: SparkSession, d: str) -> DataFrame:
    v = V.videos(spark, d)
    rows = S.concat_sources([v.where(F.col("dataset") == f"ds{i}").select("key") for i in range(3)])
    out = S.source_weighted_draws(rows, ["key"], [1.0, 2.0, 3.0], seed=7, epoch=2)
    return out.select("slot", "key", "source_id")


@query(
    "t12_video_batches",
    with_views(
        "SELECT key, CAST(floor((row_number() OVER (ORDER BY key) - 1) / 4) AS BIGINT) AS batch FROM fx_videos",
        "fx_videos",
    ),
)
def t12(spark: SparkSession, d: str) -> DataFrame:
    ranked = numbered(V.videos(spark, d).select("key"), [], ["key"], "rn")
    return ranked.select("key", S.equal_batches(F.col("rn") - 1, 4, 17).alias("batch"))


@query(
    "t13_shuffled_pair_batches",
    with_views(
        "SELECT key, CAST(floor((row_number() OVER (ORDER BY sha256('3:1:' || key), key) - 1) / 5) AS BIGINT) AS batch FROM fx_videos",
        "fx_videos",
    ),
)
def t13(spark: SparkSession, d: str) -> DataFrame:
    shuffled = S.epoch_shuffle(V.videos(spark, d).select("key"), ["key"], seed=3, epoch=1)
    return shuffled.select("key", S.equal_batches(F.col("place"), 2, 10).alias("batch"))


@query(
    "t14_epoch_shuffle",
    with_views(
        "SELECT key, row_number() OVER (ORDER BY sha256('3:1:' || key), key) - 1 AS place FROM fx_videos",
        "fx_videos",
    ),
)
def t14(spark: SparkSession, d: str) -> DataFrame:
    return S.epoch_shuffle(V.videos(spark, d).select("key"), ["key"], seed=3, epoch=1).select("key", "place")


@query(
    "w09_packed_batches",
    """WITH RECURSIVE g AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS size, row_number() OVER (ORDER BY conv_id) AS k FROM conversations GROUP BY conv_id),
f AS (SELECT k, conv_id, size, size AS fill, CAST(0 AS BIGINT) AS batch FROM g WHERE k = 1
  UNION ALL SELECT g.k, g.conv_id, g.size, CASE WHEN f.fill + g.size > 16 THEN g.size ELSE f.fill + g.size END,
    f.batch + CASE WHEN f.fill + g.size > 16 THEN 1 ELSE 0 END FROM f JOIN g ON g.k = f.k + 1)
SELECT conv_id, size, batch FROM f""",
)
def w09(spark: SparkSession, d: str) -> DataFrame:
    groups = V.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("size"))
    ranked = numbered(groups, [], ["conv_id"], "k").withColumn("group_index", F.col("k") - 1)
    return S.packed_batches(ranked, 16).select("conv_id", "size", "batch")


@query(
    "a29_distinct_repaired_frames",
    """SELECT count(DISTINCT (conv_id, turn)) AS repaired, count(DISTINCT CASE WHEN all_bad THEN conv_id END) AS skipped
FROM (SELECT conv_id, turn, bool_and(length(text) % 3 = 0) OVER (PARTITION BY conv_id) AS all_bad, length(text) % 3 = 0 AS bad FROM conversations) WHERE bad""",
)
def a29(spark: SparkSession, d: str) -> DataFrame:
    from scoreloom.operators.joins import repair_frames

    stored = V.table(spark, d, "conversations").select(
        F.col("conv_id").alias("key"), F.col("turn").alias("position"), (F.length("text") % 3 > 0).alias("good")
    )
    # every frame is in two overlapping clips, so a repaired frame shows up twice
    clips = stored.select(
        "key", "position", F.explode(F.array(F.floor(F.col("position") / 4), F.floor(F.col("position") / 4) + 100)).alias("clip_index")
    )
    out = repair_frames(clips, stored, ["key"]).where("repaired")
    return out.agg(
        F.count_distinct("key", "position").alias("repaired"),
        F.count_distinct(F.when(F.col("replacement").isNull(), F.col("key"))).alias("skipped"),
    )


def face_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two faces a frame, 25 frames a video, boxes from the vector's id."""
    v = F.col("vec_id")
    x, y = (v * 37 % 60).cast("double"), (v * 53 % 40).cast("double")
    return V.table(spark, d, "embeddings").select(
        F.floor(v / 50).alias("video"),
        F.floor(v % 50 / 2).alias("frame"),
        (v % 2).alias("face"),
        x.alias("x1"), y.alias("y1"), (x + 20 + v % 7).alias("x2"), (y + 20 + v % 5).alias("y2"),
        ((v * 29 % 100) / F.lit(100.0)).alias("score"),
        F.when(v % 11 != 0, F.col("embedding")).alias("embedding"),
        F.when(v % 3 == 0, (v % 60).cast("double")).alias("yaw"),
    )


def frame_table(faces: DataFrame, keys: list[str]) -> DataFrame:
    one = F.struct("face", "x1", "y1", "x2", "y2", "score", "embedding")
    grouped = faces.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(one)).alias("f"))
    tidy = F.transform(
        "f",
        lambda x: F.struct(
            *[x[c].alias(c) for c in ("x1", "y1", "x2", "y2", "score", "embedding")]
        ),
    )
    return grouped.select(*keys, "frame", tidy.alias("faces"))


SPEC = T.TrackSpec(iou=0.3, ema=0.7, min_score=0.2)


# Row-to-row state: checked against a plain fold in the tests.
@query("w05_face_tracks")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return T.track(frame_table(face_rows(spark, d), ["video"]), ["video"], SPEC)


@query("w05_subject_tracks")
def w05_subject(spark: SparkSession, d: str) -> DataFrame:
    faces = face_rows(spark, d)
    subject = T.subjects(faces, ["video"])
    rows = frame_table(faces, ["video"]).join(subject.select("video", "subject"), "video", "left")
    return T.track(rows, ["video"], SPEC)


@query("w06_smoothed_boxes")
def w06(spark: SparkSession, d: str) -> DataFrame:
    tracked = T.track(frame_table(face_rows(spark, d), ["video"]), ["video"], SPEC)
    return T.smooth(tracked, ["video"], SPEC)


@query("a47_subject_embeddings")
def a47(spark: SparkSession, d: str) -> DataFrame:
    out = T.subjects(face_rows(spark, d), ["video"])
    return out.select("video", "n_faces", F.aggregate("subject", F.lit(0.0), lambda a, x: a + x * x).alias("norm2"))


@query(
    "a48_track_statistics",
    """SELECT video, 'ok' AS status, count(*) FILTER (score >= 0.5) AS n_frames, round(avg(score) FILTER (score >= 0.5), 9) AS mean_confidence,
  CASE WHEN count(*) FILTER (score >= 0.5) < count(*) THEN 'short: ' || count(*) FILTER (score >= 0.5) || ' of ' || count(*) END AS reason
FROM (SELECT CAST(floor(vec_id / 25) AS BIGINT) AS video, (vec_id * 29 % 100) / CAST(100 AS DOUBLE) AS score FROM embeddings) GROUP BY video""",
)
def a48(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    faces = V.table(spark, d, "embeddings").select(
        F.floor(v / 25).alias("video"), (v % 25).alias("frame"), F.lit(0).alias("face"),
        F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(9.0).alias("x2"), F.lit(9.0).alias("y2"),
        ((v * 29 % 100) / F.lit(100.0)).alias("score"), "embedding",
    )
    tracked = T.track(frame_table(faces, ["video"]), ["video"], T.TrackSpec(min_score=0.5))
    out = T.track_stats(tracked, ["video"])
    return out.select("video", "status", "n_frames", r9("mean_confidence").alias("mean_confidence"), "reason")
