"""Queries: file listings of every release parsed into records, and publishers' splits.

Listings are derived from the orders table: each order becomes one file name in the release's
scheme, well-formed, malformed or foreign by its key. The SQL twin states what each name means.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.operators import checks as C
from scoreloom.plans import datasets as D
from scoreloom.plans import inventory as INV
from scoreloom.plans import views as V
from scoreloom.plans.catalog import query

BASE = "SELECT CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderkey AS VARCHAR) AS n, o_orderkey AS i FROM orders"
FIELDS = ("identity", "target_id", "source_id", "pair_key", "candidate")


def base(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "orders").selectExpr(
        "CAST(o_custkey AS STRING) AS c", "CAST(o_orderkey AS STRING) AS n", "o_orderkey AS i"
    )


# dataset -> one entry per kind of file: (i modulo the number of kinds picks it)
# (task or None when the file is no record, path, key, compression, {field: SQL})
_MAN, _ORG = "'manipulated_content/", "'original_content/"


def person(sql: str) -> dict[str, str]:
    return {"identity": sql, "target_id": sql}


CASES: dict[str, list[tuple]] = {
    "ffpp": [
        ("REAL", _ORG + "YouTube/c23/videos/' || c || '.mp4'", "c", "c23", person("c")),
        ("FS_DF", _MAN + "Deepfakes/raw/videos/' || c || '_' || n || '.MP4'", "c || '_' || n", "raw",
         {**person("c"), "source_id": "n", "pair_key": "c || '_' || n", "candidate": "c"}),
        (None, _MAN + "FaceSwap/c40/videos/' || c || '.mp4'", "", None, {}),
        (None, _MAN + "FaceSwap/c40/videos/x/' || c || '_' || n || '.mp4'", "", None, {}),
    ],
    "dfd": [
        ("AR", _ORG + "Actors/c40/videos/' || c || '__kitchen.mp4'", "c || '__kitchen'", "c40", person("c")),
        ("FS_DFD", _MAN + "DeepFakeDetection/c23/videos/' || c || '_' || n || '__walk__X1.mp4'",
         "c || '_' || n || '__walk__X1'", "c23",
         {**person("c"), "source_id": "n", "pair_key": "c || '__walk'", "candidate": "c || '__walk'"}),
        ("FS_DFD", _MAN + "DeepFakeDetection/c23/videos/odd' || c || '__walk__X1.mp4'",
         "'odd' || c || '__walk__X1'", "c23", {}),
        (None, _MAN + "DeepFakeDetection/c23/videos/' || c || '.txt'", "", None, {}),
    ],
    "uadfv": [
        ("REAL", _ORG + "real/videos/' || c || '.mp4'", "c", None, {"identity": "c"}),
        ("FS_FAKE", _MAN + "fake/videos/' || c || '_fake.mp4'", "c || '_fake'", None,
         {**person("c"), "pair_key": "c", "candidate": "c"}),
        ("FS_FAKE", _MAN + "fake/videos/' || c || '.mp4'", "c", None, {}),
    ],
    "celebdf-v1": [
        ("CR", _ORG + "Celeb-real/videos/id' || c || '_0007.mp4'", "'id' || c || '_0007'", None, person("'id' || c")),
        ("YTR", _ORG + "YouTube-real/videos/' || n || '.mp4'", "n", None, person("n")),
        ("FS_CS", _MAN + "Celeb-synthesis/videos/id' || c || '_id' || n || '_0003.mp4'",
         "'id' || c || '_id' || n || '_0003'", None,
         {**person("'id' || c"), "source_id": "'id' || n", "pair_key": "'id' || c || '_0003'", "candidate": "'id' || c || '_0003'"}),
        ("FS_CS", _MAN + "Celeb-synthesis/videos/x' || n || '.mp4'", "'x' || n", None, {}),
    ],
    "celebdf-v2": [
        ("CR", _ORG + "Celeb-real/videos/x' || c || '_0007.avi'", "'x' || c || '_0007'", None, {}),
        ("FS_CS", _MAN + "Celeb-synthesis/videos/id' || c || '_id' || n || '_0009.mp4'",
         "'id' || c || '_id' || n || '_0009'", None,
         {**person("'id' || c"), "source_id": "'id' || n", "pair_key": "'id' || c || '_0009'", "candidate": "'id' || c || '_0009'"}),
    ],
    "celebdf-v3": [
        ("TF_SAD", _MAN + "TalkingFace/SadTalker/videos/id' || c || '_0002_test_' || n || '.mp4'",
         "'id' || c || '_0002_test_' || n", None,
         {**person("'id' || c"), "pair_key": "'id' || c || '_0002'", "candidate": "'id' || c || '_0002'"}),
        ("FR_LIA", _MAN + "FaceReenact/LIA/videos/id' || c || '_id' || n || '_0004.mp4'",
         "'id' || c || '_id' || n || '_0004'", None,
         {**person("'id' || c"), "source_id": "'id' || n", "pair_key": "'id' || c || '_0004'", "candidate": "'id' || c || '_0004'"}),
        ("YTR", _ORG + "YouTube-real/videos/' || n || '.webm'", "n", None, person("n")),
    ],
    "dfdc": [
        ("REAL", _ORG + "testing_real/videos/a' || n || '.mp4'", "'a' || n", None, {}),
        ("FS_FAKE", _MAN + "testing_fake/videos/b' || n || '.mp4'", "'b' || n", None, {}),
    ],
    "dfdc-p": [
        ("REAL", _ORG + "original/videos/' || c || '/' || c || '_A_' || n || '.mp4'", "c || '_A_' || n", None, person("c")),
        ("FS_METHOD_B", _MAN + "method_B/videos/' || c || '/' || c || '_A/' || n || '_' || c || '_A_7_x.mp4'",
         "n || '_' || c || '_A_7_x'", None,
         {**person("c"), "source_id": "n", "pair_key": "c || '_A_7_x'", "candidate": "c || '_A_7_x'"}),
        ("FS_METHOD_A", _MAN + "method_A/videos/' || c || '/x' || n || '_' || c || '_A_7.mp4'", "'x' || n || '_' || c || '_A_7'", None, {}),
        ("REAL", _ORG + "original/videos/' || c || '_A.mp4'", "c || '_A'", None, {}),
    ],
    "deeperforensics": [
        ("SR", _ORG + "source_videos/videos/M' || c || '/light/M' || c || '_light_' || n || '.mp4'", "'M' || c || '_light_' || n", None, person("'M' || c")),
        ("FS_L3", _MAN + "end_to_end_level_3/videos/' || n || '_W' || c || '.mp4'", "n || '_W' || c", None,
         {**person("'W' || c"), "candidate": "'W' || c"}),
        ("FR_RP", _MAN + "reenact_postprocess/videos/' || n || '_' || c || '_z.mp4'", "n || '_' || c || '_z'", None, person("c || '_z'")),
        ("FS_E2E", _MAN + "end_to_end/videos/' || n || '.mp4'", "n", None, {}),
    ],
    "ffiw10k": [
        ("REAL", _ORG + "source/videos/train_' || n || '.mp4'", "'train_' || n", None, {"identity": "'train_' || n"}),
        ("FS_FAKE", _MAN + "target/videos/test_' || lpad(n, 8, '0') || '.mp4'", "'test_' || lpad(n, 8, '0')", None,
         {"identity": "'test_' || lpad(n, 8, '0')", "pair_key": "CASE WHEN i % 3 = 0 THEN 'test_' || lpad(CAST(i + 1 AS VARCHAR), 8, '0') END"}),
    ],
    "kodf": [
        ("REAL", _ORG + "actors/videos/' || c || '/a_' || c || '_001.mp4'", "'a_' || c || '_001'", None, person("'a_' || c")),
        ("FS_DFL", _MAN + "dfl/videos/d/' || c || '/' || c || '_' || n || '_3_9.mp4'", "c || '_' || n || '_3_9'", None,
         {**person("c"), "source_id": "n", "method": "'fsgan'", "candidate": "c"}),
        ("FR_FO", _MAN + "fo/videos/' || c || '_' || n || '_8_9.mp4'", "c || '_' || n || '_8_9'", None,
         {**person("c"), "source_id": "n", "candidate": "c"}),
        ("LS_AD", _MAN + "audio-driven/videos/' || c || '.mp4'", "c", None, {}),
    ],
    "dfdm": [
        ("REAL", _ORG + "Celeb-real/videos/id' || c || '_1.mp4'", "'id' || c || '_1'", None, person("'id' || c")),
        ("FS_IAE", _MAN + "IAE/c10/videos/id' || c || '_id' || n || '_0008_t.mp4'", "'id' || c || '_id' || n || '_0008_t'", "c10",
         {**person("'id' || c"), "source_id": "'id' || n", "pair_key": "'id' || c || '_0008'", "candidate": "'id' || c || '_0008'"}),
        ("FS_LW", _MAN + "LightWeight/c0/videos/id' || c || '_id' || n || '.mp4'", "'id' || c || '_id' || n", "c0", {}),
    ],
    "polyglotfake": [
        ("FR", _ORG + "fr/videos/fr_' || n || '.mp4'", "'fr_' || n", None,
         {"identity": "CASE WHEN i % 5 = 0 THEN 'film' || c || '__age30_F' ELSE 'fr' END", "target_id": "'fr'"}),
        ("LS_TO_ZH", _MAN + "to_zh/videos/fr_' || n || '_to_zh_tts.mp4'", "'fr_' || n || '_to_zh_tts'", None,
         {"identity": "CASE WHEN i % 5 = 0 THEN 'film' || c || '__age30_F' ELSE 'fr' END", "target_id": "'zh'", "source_id": "'fr'",
          "pair_key": "'fr_' || n", "candidate": "'fr_' || n"}),
        ("LS_TO_RU", _MAN + "to_ru/videos/fr_' || n || '.mp4'", "'fr_' || n", None, {"target_id": "'ru'"}),
    ],
    "deepspeak-v1": [
        ("AR", _ORG + "Actors/videos/' || c || '-0.mp4'", "c || '-0'", None, person("c")),
        ("LS_W2L", _MAN + "Wav2Lip/videos/wav2lip--' || n || '-' || c || '--41-48--0.mp4'", "'wav2lip--' || n || '-' || c || '--41-48--0'", None,
         {**person("c"), "source_id": "n", "pair_key": "c || '-48'", "candidate": "c || '-48'"}),
        ("FS_FF", _MAN + "FaceFusion/videos/facefusion--' || n || '--41-48--0.mp4'", "'facefusion--' || n || '--41-48--0'", None, {}),
        ("AR", _ORG + "Actors/videos/' || c || '.mp4'", "c", None, {}),
    ],
    "deepspeak-v2": [
        ("AR", _ORG + "Actors/videos/' || c || '-0.mp4'", "c || '-0'", None, person("c")),
        ("TF_MEMO", _MAN + "Memo/videos/memo-' || n || '-9-tts.mp4'", "'memo-' || n || '-9-tts'", None,
         {"identity": "CASE WHEN i % 3 = 0 THEN c END", "target_id": "CASE WHEN i % 3 = 0 THEN c END", "source_id": "CASE WHEN i % 3 = 0 THEN 's' || n END",
          "pair_key": "CASE WHEN i % 3 = 0 THEN c || '-r' || n END", "candidate": "CASE WHEN i % 3 = 0 THEN c || '-r' || n END"}),
    ],
    "idforge-v1": [
        ("REAL", _ORG + "pristine/videos/id' || c || '/s' || n || '/id' || c || '_scene.mp4'", "'s' || n || '__id' || c || '_scene'", None, person("'id' || c")),
        ("TTS_TG", _MAN + "tts_textgen/videos/id' || c || '/s' || n || '/id' || c || '_scene.mp3.mp4'", "'s' || n || '__id' || c || '_scene.mp3'", None,
         {**person("'id' || c"), "pair_key": "'id' || c", "candidate": "'id' || c"}),
        ("FS_TTS", _MAN + "face_tts/videos/a/s' || n || '/x' || c || '.mp4'", "'s' || n || '__x' || c", None, {}),
    ],
    "lav-df": [
        ("RVRA", _ORG + "RealVideo-RealAudio/videos/' || n || '.mp4'", "n", None, {}),
        ("FVRA", _MAN + "FakeVideo-RealAudio/videos/k/' || n || '.mp4'", "n", None,
         {"pair_key": "CASE WHEN i % 3 = 0 THEN c END", "candidate": "CASE WHEN i % 3 = 0 THEN c END"}),
    ],
    "fakeavceleb": [
        ("RVRA", _ORG + "RealVideo-RealAudio/videos/Asian (East)/men/id' || c || '/00' || n || '.mp4'",
         "'Asian_East__men__id' || c || '__00' || n", None, person("'Asian_East__men__id' || c")),
        ("FVFA", _MAN + "FakeVideo-FakeAudio/videos/African/women/id' || c || '/' || n || '_2.mp4'",
         "'African__women__id' || c || '__' || n || '_2'", None,
         {"identity": "'African__women__id' || c",
          "target_id": "CASE WHEN i % 3 = 0 THEN 'id' || c ELSE 'African__women__id' || c END",
          "source_id": "CASE WHEN i % 3 = 0 THEN 'id9' END",
          "pair_key": "CASE WHEN i % 3 = 0 THEN 'African__women__id' || c || '__' || n END",
          "method": "CASE WHEN i % 3 = 0 THEN 'wav2lip' ELSE 'FakeVideo-FakeAudio' END",
          "candidate": "CASE WHEN i % 3 = 0 THEN 'African__women__id' || c || '__' || n END"}),
        ("FVRA", _MAN + "FakeVideo-RealAudio/videos/A/w/id' || c || '/_fake.mp4'", "'A__w__id' || c || '__fake'", None,
         {"identity": "'A__w__id' || c", "target_id": "'A__w__id' || c", "pair_key": "'A__w__id' || c",
          "candidate": "'A__w__id' || c"}),
    ],
    "talkingheadbench": [
        ("TH_LP", _MAN + "LivePortrait/videos/1--drv' || c || '--LivePortrait.mp4'", "'1--drv' || c || '--LivePortrait'", None,
         {"source_id": "'drv' || c", "candidate": "'drv' || c"}),
        ("TH_H3", _MAN + "Hallo3/videos/' || n || '-dash' || c || '.mp4'", "n || '-dash' || c", None,
         {"source_id": "'-dash' || c", "candidate": "'-dash' || c"}),
        ("TH_M1", _MAN + "MAGI-1/videos/' || n || '.mp4'", "n", None, {}),
    ],
    "synthetic": [
        ("REAL", "'original/' || c || '.mkv'", "c", None, person("c")),
        ("BLEND_A", "'blend-a/' || c || '_' || n || '.mkv'", "c || '_' || n", None,
         {**person("c"), "source_id": "n", "pair_key": "c", "candidate": "c"}),
        ("BLEND_B", "'blend-b/' || c || '__' || n || '.mkv'", "c || '__' || n", None, {}),
    ],
}
NAMES = {
    "ffpp": "b01", "dfd": "b02", "uadfv": "b03", "celebdf-v1": "b04", "celebdf-v2": "b04", "celebdf-v3": "b04",
    "dfdc": "b05", "dfdc-p": "b06", "deeperforensics": "b07", "ffiw10k": "b09", "kodf": "b10", "dfdm": "b11",
    "fakeavceleb": "b12", "polyglotfake": "b13", "deepspeak-v1": "b14", "deepspeak-v2": "b14", "idforge-v1": "b15",
    "lav-df": "b16", "talkingheadbench": "b18", "synthetic": "b19",
}


def path_sql(dataset: str) -> str:
    kinds = CASES[dataset]
    whens = " ".join(f"WHEN i % {len(kinds)} = {k} THEN {c[1]}" for k, c in enumerate(kinds))
    return f"CASE {whens} END"


def listing(spark: SparkSession, d: str, dataset: str) -> DataFrame:
    return base(spark, d).selectExpr(f"{path_sql(dataset)} AS relpath")


def twin_sql(dataset: str) -> str:
    release = D.RELEASES[dataset]
    methods = {t.abbr: t.method for t in release.tasks}
    selects = []
    for k, (task, _, key, compression, fields) in enumerate(CASES[dataset]):
        if task is None:
            continue
        cells = [f"{fields.get(f, 'CAST(NULL AS VARCHAR)')} AS {f}" for f in FIELDS]
        method = fields.get("method", f"'{methods[task]}'")
        comp = "CAST(NULL AS VARCHAR)" if compression is None else f"'{compression}'"
        selects.append(
            f"SELECT '{task}/' || {key} AS key, {comp} AS compression, '{release.label_key(task)}' AS label_key, {method} AS method, {', '.join(cells)}"
            f" FROM b WHERE i % {len(CASES[dataset])} = {k}"
        )
    return f"WITH b AS ({BASE})\n" + "\nUNION ALL ".join(selects)


def side_table(spark: SparkSession, d: str, dataset: str) -> DataFrame | None:
    """Side metadata in each release's own shape, for every third (or fifth) order."""
    b = base(spark, d)
    if dataset == "ffiw10k":
        rows = b.where("i % 3 = 0 AND i % 2 = 1").selectExpr("0 AS list_rank", "i AS place", "i AS source", "i + 1 AS target")
        return INV.pair_map_side(rows)
    if dataset == "polyglotfake":
        rows = b.where("i % 5 = 0").selectExpr(
            "0 AS rank", "i AS place", "'fr_' || n || '.mp4' AS filename", "'film' || c AS source", "30 AS age", "'F' AS sex"
        )
        return INV.speaker_side(rows)
    if dataset == "deepspeak-v2":
        rows = b.where("i % 3 = 0").selectExpr(
            "'memo-' || n || '-9-tts.mp4' AS `video-file`", "i AS line", "'s' || n AS `identity-source`", "c AS `identity-target`",
            "'r' || n AS `recording-target`", "'memo' AS engine", "'tts' AS `audio-config`",
        )
        return INV.annotation_side(rows)
    if dataset == "lav-df":
        rows = b.where("i % 3 = 0 AND i % 2 = 1").selectExpr(
            "'train/' || n || '.mp4' AS file", "i AS place", "'train/' || c || '.mp4' AS original", "1 AS n_fakes",
            "array(array(0.5D, 1.0D)) AS fake_periods", "true AS modify_video", "false AS modify_audio", "2.5D AS duration",
            "60 AS video_frames", "1 AS audio_channels", "100 AS audio_frames",
        )
        return INV.lavdf_side(rows)
    if dataset == "fakeavceleb":
        rows = b.where("i % 3 = 0").selectExpr(
            "i AS line", "'FakeVideo-FakeAudio' AS type", "'African' AS race", "'women' AS gender", "'id' || c AS source",
            "'id9' AS target1", "'wav2lip' AS method", "'D' AS category", "n || '_2.mp4' AS path",
        )
        return INV.fakeavceleb_side(rows)
    if dataset == "talkingheadbench":
        rows = b.selectExpr("'CelebV-HQ' AS source", "'-dash' || c AS id").unionByName(
            b.selectExpr("'CelebV-HQ' AS source", "'drv' || c AS id")
        )
        return INV.driver_side(rows)
    return None


SIDE_KEY = {
    "polyglotfake": lambda: F.when(F.col("kind") == "real", F.col("file_name")).otherwise(
        F.concat(F.nullif(D.dub_real(F.col("stem")), F.lit("")), F.lit(".mp4"))
    ),
    "fakeavceleb": lambda: D._path_key(F.col("below")),
    "talkingheadbench": lambda: D.thb_driver(F.col("stem"), F.col("task")),
}


def records(spark: SparkSession, d: str, dataset: str) -> DataFrame:
    release = D.RELEASES[dataset]
    key = SIDE_KEY[dataset]() if dataset in SIDE_KEY else None
    return INV.parse_listing(
        listing(spark, d, dataset), release, side=side_table(spark, d, dataset), side_key=key
    )


def _parser(dataset: str) -> None:
    name = f"{NAMES[dataset]}_{dataset.replace('-', '_')}_records"

    @query(name, twin_sql(dataset))
    def plan(spark: SparkSession, d: str) -> DataFrame:
        release = D.RELEASES[dataset]
        fakes = [release.label_key(t.abbr) for t in release.tasks if t.kind == "fake"]
        rows = INV.with_local(records(spark, d, dataset))
        candidate = F.when(F.col("label_key").isin(fakes), INV.candidates(release))
        return rows.select(
            "key", "compression", "label_key", "method", *INV.TEXT_FIELDS, candidate.alias("candidate")
        )


for _d in CASES:
    _parser(_d)


def three_lists(spark: SparkSession, d: str, id_sql: str) -> DataFrame:
    """Publisher's lists: every order's id in one list, some in two."""
    b = base(spark, d)
    first = b.selectExpr(f"{id_sql} AS id", "CASE i % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split")
    again = b.where("i % 7 = 0").selectExpr(f"{id_sql} AS id", "'test' AS split")
    return first.unionByName(again)


LISTS = """SELECT {id} AS id, CASE i % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM b
UNION ALL SELECT {id}, 'test' FROM b WHERE i % 7 = 0"""
FIRST = "SELECT id, arg_min(split, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS split FROM l GROUP BY id"

# dataset -> (list id, id of a record in SQL over the twin's columns, extra filter)
OFFICIAL = {
    "ffpp": ("c", "split_part(substr(key, strpos(key, '/') + 1), '_', 1)", "true"),
    "celebdf-v1": ("'id' || c || '_0007'", "substr(key, strpos(key, '/') + 1)", "true"),
    "dfdc": ("'b' || n", "substr(key, strpos(key, '/') + 1)", "true"),
    "dfdc-p": ("c || '_A_' || n", "substr(key, strpos(key, '/') + 1)", "true"),
    "deepspeak-v1": ("c", "identity", "f.split <> 'val'"),
    "idforge-v1": ("'s' || n || '__id' || c || '_scene'", "substr(key, strpos(key, '/') + 1)", "true"),
    "lav-df": ("n", "substr(key, strpos(key, '/') + 1)", "true"),
    "synthetic": ("c", "identity", "true"),
}


def _official(dataset: str, list_id: str, record_id: str, extra: str) -> None:
    name = f"{NAMES[dataset]}_{dataset.replace('-', '_')}_official"
    body = twin_sql(dataset)[len(f"WITH b AS ({BASE})\n") :]

    @query(
        name,
        f"WITH b AS ({BASE}), r AS ({body}), l AS ({LISTS.format(id=list_id)}), f AS ({FIRST})\n"
        f"SELECT DISTINCT r.key, f.split FROM r JOIN f ON f.id = {record_id} WHERE {extra}",
    )
    def plan(spark: SparkSession, d: str) -> DataFrame:
        return INV.official_splits(
            D.RELEASES[dataset], records(spark, d, dataset), three_lists(spark, d, list_id)
        )


for _d, (_i, _r, _x) in OFFICIAL.items():
    _official(_d, _i, _r, _x)


@query(
    "b07_deeperforensics_official",
    f"""WITH b AS ({BASE}), l AS ({LISTS.format(id="n || '_W' || c || '.mp4'")}),
  l2 AS (SELECT * FROM l UNION ALL SELECT '0_M' || c || '.mp4', CASE i % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END FROM b WHERE i % 9 = 0),
  o AS (SELECT id, arg_min(split, CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS split FROM l2 GROUP BY id),
  a AS (SELECT split_part(split_part(id, '.', 1), '_', 2) AS actor, arg_min(split, CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS split FROM l2 GROUP BY 1)
SELECT DISTINCT 'SR/M' || c || '_light_' || n AS key, a.split FROM b JOIN a ON a.actor = 'M' || c WHERE i % 4 = 0
UNION ALL SELECT 'FS_L3/' || n || '_W' || c, o.split FROM b JOIN o ON o.id = n || '_W' || c || '.mp4' WHERE i % 4 = 1""",
)
def b07_official(spark: SparkSession, d: str) -> DataFrame:
    more = base(spark, d).where("i % 9 = 0").selectExpr(
        "'0_M' || c || '.mp4' AS id", "CASE i % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split"
    )
    lists = three_lists(spark, d, "n || '_W' || c || '.mp4'").unionByName(more)
    return INV.official_splits(D.DEEPER, records(spark, d, "deeperforensics"), lists)


def _wild_listing(spark: SparkSession, d: str) -> DataFrame:
    """A frame listing: each line item is one frame of its order's sequence."""
    return V.table(spark, d, "lineitem").selectExpr(
        "CASE WHEN l_orderkey % 2 = 0 THEN 'original_content/real/frames/224w_224h_wild_precropped/real_' ELSE"
        " 'manipulated_content/fake/frames/224w_224h_wild_precropped/fake_' END"
        " || CASE l_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'extra' END || '_6_' || l_orderkey"
        " || '/' || CASE WHEN l_linenumber = 7 THEN '.' ELSE '' END || lpad(CAST(l_partkey AS STRING), 6, '0') || '.PNG' AS relpath"
    )


_WILD = """SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'REAL/real_' ELSE 'FAKE/fake_' END || CASE l_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'extra' END || '_6_' || l_orderkey AS key,
  CASE l_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' END AS split, CAST(count(*) AS VARCHAR) AS n_frames, CAST(l_orderkey AS VARCHAR) AS sequence
FROM lineitem WHERE l_linenumber <> 7 GROUP BY l_orderkey"""


def _wild(spark: SparkSession, d: str) -> DataFrame:
    return INV.parse_listing(INV.wild_folders(_wild_listing(spark, d)), D.WILD, folders=True)


@query("b08_wilddeepfake_records", _WILD)
def b08(spark: SparkSession, d: str) -> DataFrame:
    attr = lambda k: F.element_at("attrs", F.lit(k)).alias(k)
    return _wild(spark, d).select("key", attr("split"), attr("n_frames"), attr("sequence"))


@query("b08_wilddeepfake_official", f"SELECT key, split FROM ({_WILD}) WHERE split IS NOT NULL")
def b08_official(spark: SparkSession, d: str) -> DataFrame:
    return INV.official_splits(D.WILD, _wild(spark, d))


@query(
    "b09_ffiw10k_official",
    f"""WITH b AS ({BASE}) SELECT 'REAL/train_' || n AS key, 'train' AS split FROM b WHERE i % 2 = 0
UNION ALL SELECT 'FS_FAKE/test_' || lpad(n, 8, '0'), 'test' FROM b WHERE i % 2 = 1""",
)
def b09_official(spark: SparkSession, d: str) -> DataFrame:
    return INV.official_splits(D.FFIW, records(spark, d, "ffiw10k"))


@query(
    "b16_lav_df_release_folders",
    f"""WITH b AS ({BASE}) SELECT 'FVRA/' || n AS key, 'FakeVideo-RealAudio' AS method, c AS pair_key FROM b WHERE i % 3 = 0 AND i % 2 = 1""",
)
def b16_release(spark: SparkSession, d: str) -> DataFrame:
    files = base(spark, d).selectExpr("'.official_files/LAV-DF/dev/' || n || '.mp4' AS relpath")
    out = INV.lavdf_release_records(files, side_table(spark, d, "lav-df"))
    return out.select("key", "method", "pair_key")


@query(
    "b17_av_deepfake1m_pp_records",
    f"""WITH b AS ({BASE})
SELECT 'LS_TALKLIP/vox_celeb_2__id0' || lpad(c, 4, '0') || '__a_b__' || n || '__fake' AS key, 'vox2:id0' || lpad(c, 4, '0') AS identity, 'vox_celeb_2__id0__' || n || '__real' AS pair_key,
  CAST(NULL AS VARCHAR) AS parent_key, CAST(NULL AS VARCHAR) AS upstream_source, 'id0' || lpad(c, 4, '0') AS vox2_id, CAST(NULL AS VARCHAR) AS problem FROM b WHERE i % 4 = 0
UNION ALL SELECT 'RVFA/lrs3__' || c || '__' || n, 'lrs3:' || c, NULL, 'lrs3__' || c || '__whole', NULL, NULL, NULL FROM b WHERE i % 4 = 1
UNION ALL SELECT 'RVRA/silent_videos__subject_' || c || '_h_vid_1_2__' || n, 'silent:subject_' || c, NULL, NULL, 'Up/x.mp4', NULL, NULL FROM b WHERE i % 4 = 2
UNION ALL SELECT NULL, 'lrs3:' || c, NULL, NULL, NULL, NULL, 'unknown task' FROM b WHERE i % 4 = 3""",
)
def b17(spark: SparkSession, d: str) -> DataFrame:
    rows = base(spark, d).selectExpr(
        "CASE i % 4 WHEN 0 THEN 'vox_celeb_2/id0' || lpad(c, 4, '0') || '/a-b/' || n || '/fake.mp4' WHEN 1 THEN 'lrs3/' || c || '/' || n || '.mp4'"
        " WHEN 2 THEN 'silent_videos/subject_' || c || '_h_vid_1_2/' || n || '.mp4' ELSE 'lrs3/' || c || '/' || n || '.mp4' END AS file",
        "CASE i % 4 WHEN 0 THEN 'vox_celeb_2/id0/' || n || '/real.mp4' WHEN 1 THEN 'lrs3/' || c || '/whole.mp4' WHEN 2 THEN 'Up/x.mp4' END AS original",
        "CASE i % 4 WHEN 0 THEN 'visual_modified' WHEN 1 THEN 'audio_modified' WHEN 2 THEN 'real' ELSE 'visual_modified' END AS modify_type",
        "CASE i % 4 WHEN 0 THEN 'Talklip' WHEN 3 THEN 'new' END AS video_model", "i % 2 AS audio_frames",
    )
    out = INV.metadata_records(rows, "raw_content")
    return out.select("key", "identity", "pair_key", "parent_key", "upstream_source", "vox2_id", "problem")


@query(
    "b18_talkingheadbench_official",
    f"""WITH b AS ({BASE}), l AS (SELECT 'drv' || c AS id, max(CASE i % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS s FROM b GROUP BY 1)
SELECT DISTINCT 'REAL_CVHQ/' || id AS key, CASE s WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM l
UNION ALL SELECT DISTINCT 'TH_LP/1--drv' || c || '--LivePortrait', CASE WHEN s = 2 THEN 'test' ELSE 'train' END FROM b JOIN l ON id = 'drv' || c WHERE i % 3 = 0
UNION ALL SELECT 'TH_H3/' || n || '-dash' || c, 'test' FROM b WHERE i % 3 = 1
UNION ALL SELECT 'TH_M1/' || n, 'test' FROM b WHERE i % 3 = 2""",
)
def b18_official(spark: SparkSession, d: str) -> DataFrame:
    lists = base(spark, d).selectExpr(
        "'CelebV-HQ' AS source", "'drv' || c AS id", "CASE i % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split"
    )
    reals = INV.listed_reals(lists)
    fakes = records(spark, d, "talkingheadbench")
    both = reals.select("key", "relpath", "source_id", "identity").unionByName(
        fakes.select("key", "relpath", "source_id", "identity")
    )
    return INV.official_splits(D.THB, both, lists)


@query(
    "j15_metadata_enrichment",
    f"""WITH b AS ({BASE}) SELECT 'TF_MEMO/memo-' || n || '-9-tts' AS key, CASE WHEN i % 3 = 0 THEN c END AS target_id,
  'memo' AS engine, 'tts' AS audio_config FROM b WHERE i % 2 = 1""",
)
def j15(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d, "deepspeak-v2").where(F.col("label_key") == "DSv2-TF_MEMO")
    attr = lambda k: F.element_at("attrs", F.lit(k)).alias(k)
    return rows.select("key", "target_id", attr("engine"), attr("audio_config"))


@query(
    "a32_inventory_counts",
    f"""WITH b AS ({BASE}), r AS ({twin_sql('kodf')[len(f"WITH b AS ({BASE})") :]})
SELECT split_part(key, '/', 1) AS "group", count(*) AS n FROM r GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM r""",
)
def a32(spark: SparkSession, d: str) -> DataFrame:
    return INV.inventory_counts(records(spark, d, "kodf"))


@query(
    "r09_inventory_of_copies",
    f"""WITH b AS ({BASE}), f AS (SELECT *, CASE WHEN i % 4 = 0 THEN 'REAL' ELSE 'FS_DF' END AS task, CASE WHEN i % 4 = 0 THEN 'c23' ELSE 'raw' END AS compression,
  CASE WHEN i % 4 = 0 THEN i % 3 ELSE 1 + i % 2 END AS copy_index FROM b WHERE i % 4 < 2)
SELECT task || '/' || CASE WHEN task = 'REAL' THEN c ELSE c || '_' || n END AS key, compression, count(*) AS n FROM f
WHERE copy_index = (SELECT min(copy_index) FROM f g WHERE g.task = f.task) GROUP BY ALL""",
)
def r09(spark: SparkSession, d: str) -> DataFrame:
    files = base(spark, d).selectExpr(
        f"{path_sql('ffpp')} AS relpath", "CASE WHEN i % 4 = 0 THEN i % 3 ELSE 1 + i % 2 END AS copy_index"
    )
    out = INV.first_copies(INV.parse_listing(files, D.FFPP))
    return C.key_counts(out, ["key", "compression"])


@query(
    "f06_label_vocabulary",
    f"""WITH b AS ({BASE}), r AS ({twin_sql('idforge-v1')[len(f"WITH b AS ({BASE})") :]})
SELECT label_key, CAST(CASE WHEN label_key = 'IDFv1-FS_TTS' THEN 1 ELSE 0 END AS INTEGER) AS "binary", CAST(CASE WHEN label_key = 'IDFv1-REAL' THEN 0 ELSE 1 END AS INTEGER) AS binary_av,
  CASE label_key WHEN 'IDFv1-REAL' THEN 'real' WHEN 'IDFv1-FS_TTS' THEN 'face-swap' ELSE 'audio-only' END AS family, count(*) AS n FROM r GROUP BY ALL""",
)
def f06(spark: SparkSession, d: str) -> DataFrame:
    # a row per task: sent to the records, which have too few label keys to be dealt by them
    rows = records(spark, d, "idforge-v1").join(F.broadcast(INV.label_vocab(spark, D.IDFORGE).drop("method")), "label_key")
    return rows.groupBy("label_key", "binary", "binary_av", "family").agg(F.count("*").alias("n"))
