"""Dataset tables: how each public release names its files, and what the names say.

A release is a table of tasks and labels (fixed values of the releases) plus column expressions over
the file stem. Parsing a listing of any size is one projection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions.keys import sanitised

# Fixed value: file suffixes that count as videos.
VIDEO_SUFFIXES = ("mp4", "avi", "mov", "mkv", "webm", "m4v")


@dataclass(frozen=True)
class Task:
    """One source of reals or one generation method: where its videos are and what they are called."""

    abbr: str
    name: str
    kind: str
    folder: str
    method: str
    recursive: bool = False


@dataclass(frozen=True)
class Label:
    """A task's label under each published mapping."""

    binary: int
    binary_av: int
    multiclass: int
    family: str


def null() -> Column:
    return F.lit(None).cast("string")


def part(text: Column, sep: str, i: int) -> Column:
    """The i-th part of a text, null when there are fewer."""
    return F.get(F.split(text, sep), i)


def parts(text: Column, sep: str) -> Column:
    return F.size(F.split(text, sep))


@dataclass(frozen=True)
class Release:
    """What a dataset's file names say.

    `fake` and `real` give columns (any of key, identity, target_id, source_id, pair_key, method,
    attrs, keep) from the parse context: `stem`, `relpath`, `below` (the path under the task's
    folder), `task` name and joined side metadata. `candidates` says what a fake pairs with;
    `official` is the id a publisher's list is looked up by.
    """

    dataset: str
    folder: str
    prefix: str
    tasks: tuple[Task, ...]
    labels: Mapping[str, Label]
    real: Callable[[], Mapping[str, Column]] = dict
    fake: Callable[[], Mapping[str, Column]] = dict
    candidates: Callable[[], Column] = null
    official: Callable[[], Column] | None = None
    compressions: tuple[str, ...] = ()
    pairing_rule: str | None = None
    pairing_fanout: int | None = None
    default_scheme: str = "all-test"
    benchmark: Mapping[str, object] = field(default_factory=dict)
    local_attrs: tuple[str, ...] = ()

    @property
    def task_rank(self) -> dict[str, int]:
        return {t.abbr: i for i, t in enumerate(self.tasks)}

    def label_key(self, abbr: str) -> str:
        return f"{self.prefix}-{abbr}"


def _stem() -> Column:
    return F.col("stem")


def _same_person(person: Column) -> dict[str, Column]:
    return {"identity": person, "target_id": person}


def _when(ok: Column, values: dict[str, Column]) -> dict[str, Column]:
    return {k: F.when(ok, v) for k, v in values.items()}


def _local() -> Column:
    return F.col("local")


# --- FaceForensics++: fakes are <target>_<source>; other names in a method folder are no fakes


def _ffpp_fake() -> dict[str, Column]:
    target, source = part(_stem(), "_", 0), part(_stem(), "_", 1)
    return {
        **_same_person(target),
        "source_id": source,
        "pair_key": F.concat_ws("_", target, source),
        "keep": F.contains(_stem(), F.lit("_")),
    }


# The release's names, folders and class numbers.
FFPP = Release(
    "ffpp", "FaceForensics++", "FF",
    (
        Task("REAL", "YouTube", "real", "original_content/YouTube/{cX}/videos", "original"),
        Task("FS_DF", "Deepfakes", "fake", "manipulated_content/Deepfakes/{cX}/videos", "Deepfakes"),
        Task("FR_F2F", "Face2Face", "fake", "manipulated_content/Face2Face/{cX}/videos", "Face2Face"),
        Task("FS_FSH", "FaceShifter", "fake", "manipulated_content/FaceShifter/{cX}/videos", "FaceShifter"),
        Task("FS_FS", "FaceSwap", "fake", "manipulated_content/FaceSwap/{cX}/videos", "FaceSwap"),
        Task("FR_NT", "NeuralTextures", "fake", "manipulated_content/NeuralTextures/{cX}/videos", "NeuralTextures"),
    ),
    {
        "REAL": Label(0, 0, 1, "real"),
        "FS_DF": Label(1, 1, 2, "face-swap"),
        "FR_F2F": Label(1, 1, 3, "face-reenactment"),
        "FS_FSH": Label(1, 1, 4, "face-swap"),
        "FS_FS": Label(1, 1, 5, "face-swap"),
        "FR_NT": Label(1, 1, 6, "face-reenactment"),
    },
    real=lambda: _same_person(_stem()),
    fake=_ffpp_fake,
    candidates=lambda: F.coalesce("target_id", part(_local(), "_", 0)),
    official=lambda: part(_local(), "_", 0),
    compressions=("raw", "c23", "c40"),
    pairing_rule="target-id",
    default_scheme="official",
    benchmark={"k_fake": 500, "compressions": ("c23",)},
)

# --- DeepFakeDetection: reals <actor>__<scene>; fakes <target>_<source>__<scene>__<code>


def _dfd_ok(stem: Column) -> Column:
    return (parts(stem, "__") >= 3) & (parts(part(stem, "__", 0), "_") >= 2)


def _dfd_pair(stem: Column) -> Column:
    pair = F.concat_ws("__", part(part(stem, "__", 0), "_", 0), part(stem, "__", 1))
    return F.when(_dfd_ok(stem), pair)


def _dfd_fake() -> dict[str, Column]:
    ids = part(_stem(), "__", 0)
    who = {**_same_person(part(ids, "_", 0)), "source_id": part(ids, "_", 1)}
    return {**_when(_dfd_ok(_stem()), who), "pair_key": _dfd_pair(_stem())}


# The release's names, folders and class numbers.
DFD = Release(
    "dfd", "FaceForensics++", "DFD",
    (
        Task("AR", "Actors-real", "real", "original_content/Actors/{cX}/videos", "original"),
        Task("FS_DFD", "DeepFakeDetection", "fake", "manipulated_content/DeepFakeDetection/{cX}/videos", "deepfakedetection"),
    ),
    {
        "AR": Label(0, 0, 1, "real"),
        "FS_DFD": Label(1, 1, 2, "face-swap"),
    },
    real=lambda: _same_person(F.nullif(part(_stem(), "__", 0), F.lit(""))),
    fake=_dfd_fake,
    candidates=lambda: _dfd_pair(_local()),
    compressions=("raw", "c23", "c40"),
    pairing_rule="target-scene",
    default_scheme="ident-72-14-14",
    benchmark={"k_fake": 100, "compressions": ("c23",)},
)

# --- UADFV: <n>_fake is the swapped copy of <n>


def _strip_fake(stem: Column) -> Column:
    return F.when(F.endswith(stem, F.lit("_fake")), F.regexp_extract(stem, "^(.*)_fake$", 1))


# The release's names, folders and class numbers.
UADFV = Release(
    "uadfv", "UADFV", "UADFV",
    (
        Task("REAL", "real", "real", "original_content/real/videos", "original"),
        Task("FS_FAKE", "fake", "fake", "manipulated_content/fake/videos", "faceswap"),
    ),
    {
        "REAL": Label(0, 0, 1, "real"),
        "FS_FAKE": Label(1, 1, 2, "face-swap"),
    },
    real=lambda: {"identity": _stem()},
    fake=lambda: {**_same_person(_strip_fake(_stem())), "pair_key": _strip_fake(_stem())},
    candidates=lambda: _strip_fake(_local()),
    pairing_rule="strip-fake-suffix",
)

# --- Celeb-DF v1 to v3: <target>_<source>_<rec>, or <target>_<rec>_... for talking faces


def _celeb_pair(stem: Column) -> Column:
    swapped = (parts(stem, "_") >= 3) & F.startswith(part(stem, "_", 1), F.lit("id"))
    rec = F.when(swapped, part(stem, "_", 2)).otherwise(part(stem, "_", 1))
    ok = (parts(stem, "_") >= 2) & F.startswith(stem, F.lit("id"))
    return F.when(ok, F.concat_ws("_", part(stem, "_", 0), rec))


def _celeb_fake() -> dict[str, Column]:
    s = _stem()
    ok = (parts(s, "_") >= 2) & F.startswith(s, F.lit("id"))
    swapped = ok & (parts(s, "_") >= 3) & F.startswith(part(s, "_", 1), F.lit("id"))
    return {
        **_when(ok, _same_person(part(s, "_", 0))),
        "source_id": F.when(swapped, part(s, "_", 1)),
        "pair_key": _celeb_pair(s),
    }


def _celeb_real() -> dict[str, Column]:
    s = _stem()
    person = F.when(s.rlike(r"^id\d+_\d+$"), part(s, "_", 0)).when(s.rlike(r"^\d+$"), s)
    return _same_person(person)


def _celeb(
    version: str, tasks: tuple[Task, ...], labels: Mapping[str, Label], benchmark: dict
) -> Release:
    return Release(
        f"celebdf-{version}", f"Celeb-DF-{version}", f"CDF{version}",
        tasks, labels,
        real=_celeb_real, fake=_celeb_fake, candidates=lambda: _celeb_pair(_local()),
        official=_local, pairing_rule="target-recording",
        default_scheme="official+ident-80-20", benchmark=benchmark,
    )


# The release's names, folders and class numbers.
CELEBDF_V1 = _celeb("v1", (
        Task("CR", "Celeb-real", "real", "original_content/Celeb-real/videos", "original"),
        Task("YTR", "YouTube-real", "real", "original_content/YouTube-real/videos", "original"),
        Task("FS_CS", "Celeb-synthesis", "fake", "manipulated_content/Celeb-synthesis/videos", "Celeb-synthesis"),
    ), {
        "CR": Label(0, 0, 1, "real"),
        "YTR": Label(0, 0, 2, "real"),
        "FS_CS": Label(1, 1, 3, "face-swap"),
    }, {"k_fake": 100})
# The release's names, folders and class numbers.
CELEBDF_V2 = _celeb("v2", (
        Task("CR", "Celeb-real", "real", "original_content/Celeb-real/videos", "original"),
        Task("YTR", "YouTube-real", "real", "original_content/YouTube-real/videos", "original"),
        Task("FS_CS", "Celeb-synthesis", "fake", "manipulated_content/Celeb-synthesis/videos", "Celeb-synthesis"),
    ), {
        "CR": Label(0, 0, 1, "real"),
        "YTR": Label(0, 0, 2, "real"),
        "FS_CS": Label(1, 1, 3, "face-swap"),
    }, {"k_fake": 100})


# The release's names, folders and class numbers.
CELEBDF_V3 = _celeb(
    "v3",
    (
        Task("CR", "Celeb-real", "real", "original_content/Celeb-real/videos", "original"),
        Task("YTR", "YouTube-real", "real", "original_content/YouTube-real/videos", "original"),
        Task("FS_CDFV2", "Celeb-DF-v2", "fake", "manipulated_content/FaceSwap/Celeb-DF-v2/videos", "Celeb-DF-v2"),
        Task("FS_BLEND", "BlendFace", "fake", "manipulated_content/FaceSwap/BlendFace/videos", "BlendFace"),
        Task("FS_GHOST", "GHOST", "fake", "manipulated_content/FaceSwap/GHOST/videos", "GHOST"),
        Task("FS_HIFI", "HifiFace", "fake", "manipulated_content/FaceSwap/HifiFace/videos", "HifiFace"),
        Task("FS_INSW", "InSwapper", "fake", "manipulated_content/FaceSwap/InSwapper/videos", "InSwapper"),
        Task("FS_MOBILE", "MobileFaceSwap", "fake", "manipulated_content/FaceSwap/MobileFaceSwap/videos", "MobileFaceSwap"),
        Task("FS_SIM", "SimSwap", "fake", "manipulated_content/FaceSwap/SimSwap/videos", "SimSwap"),
        Task("FS_UNI", "UniFace", "fake", "manipulated_content/FaceSwap/UniFace/videos", "UniFace"),
        Task("FR_DAGAN", "DaGAN", "fake", "manipulated_content/FaceReenact/DaGAN/videos", "DaGAN"),
        Task("FR_FSRT", "FSRT", "fake", "manipulated_content/FaceReenact/FSRT/videos", "FSRT"),
        Task("FR_HYPER", "HyperReenact", "fake", "manipulated_content/FaceReenact/HyperReenact/videos", "HyperReenact"),
        Task("FR_LIA", "LIA", "fake", "manipulated_content/FaceReenact/LIA/videos", "LIA"),
        Task("FR_LP", "LivePortrait", "fake", "manipulated_content/FaceReenact/LivePortrait/videos", "LivePortrait"),
        Task("FR_MCNET", "MCNET", "fake", "manipulated_content/FaceReenact/MCNET/videos", "MCNET"),
        Task("FR_TPSMM", "TPSMM", "fake", "manipulated_content/FaceReenact/TPSMM/videos", "TPSMM"),
        Task("TF_ANI", "AniTalker", "fake", "manipulated_content/TalkingFace/AniTalker/videos", "AniTalker"),
        Task("TF_ECHO", "EchoMimic", "fake", "manipulated_content/TalkingFace/EchoMimic/videos", "EchoMimic"),
        Task("TF_EDTALK", "EDTalk", "fake", "manipulated_content/TalkingFace/EDTalk/videos", "EDTalk"),
        Task("TF_FLOAT", "FLOAT", "fake", "manipulated_content/TalkingFace/FLOAT/videos", "FLOAT"),
        Task("TF_IPLAP", "IP_LAP", "fake", "manipulated_content/TalkingFace/IP_LAP/videos", "IP_LAP"),
        Task("TF_REAL3D", "Real3DPortrait", "fake", "manipulated_content/TalkingFace/Real3DPortrait/videos", "Real3DPortrait"),
        Task("TF_SAD", "SadTalker", "fake", "manipulated_content/TalkingFace/SadTalker/videos", "SadTalker"),
    ),
    {
        "CR": Label(0, 0, 1, "real"),
        "YTR": Label(0, 0, 2, "real"),
        "FR_DAGAN": Label(1, 1, 3, "face-reenactment"),
        "FR_FSRT": Label(1, 1, 4, "face-reenactment"),
        "FR_HYPER": Label(1, 1, 5, "face-reenactment"),
        "FR_LIA": Label(1, 1, 6, "face-reenactment"),
        "FR_LP": Label(1, 1, 7, "face-reenactment"),
        "FR_MCNET": Label(1, 1, 8, "face-reenactment"),
        "FR_TPSMM": Label(1, 1, 9, "face-reenactment"),
        "FS_BLEND": Label(1, 1, 10, "face-swap"),
        "FS_CDFV2": Label(1, 1, 11, "face-swap"),
        "FS_GHOST": Label(1, 1, 12, "face-swap"),
        "FS_HIFI": Label(1, 1, 13, "face-swap"),
        "FS_INSW": Label(1, 1, 14, "face-swap"),
        "FS_MOBILE": Label(1, 1, 15, "face-swap"),
        "FS_SIM": Label(1, 1, 16, "face-swap"),
        "FS_UNI": Label(1, 1, 17, "face-swap"),
        "TF_ANI": Label(1, 1, 18, "talking-face"),
        "TF_ECHO": Label(1, 1, 19, "talking-face"),
        "TF_EDTALK": Label(1, 1, 20, "talking-face"),
        "TF_FLOAT": Label(1, 1, 21, "talking-face"),
        "TF_IPLAP": Label(1, 1, 22, "talking-face"),
        "TF_REAL3D": Label(1, 1, 23, "talking-face"),
        "TF_SAD": Label(1, 1, 24, "talking-face"),
    },
    {"k_fake": 2, "strata": ("identity", "task")},
)

# --- DFDC test set: opaque names; listed stems are test

# The release's names, folders and class numbers.
DFDC = Release(
    "dfdc", "DFDC", "DFDC",
    (
        Task("REAL", "testing_real", "real", "original_content/testing_real/videos", "original"),
        Task("FS_FAKE", "testing_fake", "fake", "manipulated_content/testing_fake/videos", "deepfake"),
    ),
    {
        "REAL": Label(0, 0, 1, "real"),
        "FS_FAKE": Label(1, 1, 2, "face-swap"),
    },
    official=_local, default_scheme="official", benchmark={"k_fake": 1000},
)

# --- DFDC preview: <swapped>_<target>_<suffix>_<counter>


def _dfdcp_ok(s: Column) -> Column:
    return s.rlike(r"^\d+_\d+_[^_]*_")


def _dfdcp_pair(s: Column) -> Column:
    return F.when(_dfdcp_ok(s), F.substr(s, F.instr(s, "_") + 1))


def _dfdcp_fake() -> dict[str, Column]:
    s = _stem()
    who = {**_same_person(part(s, "_", 1)), "source_id": part(s, "_", 0)}
    return {**_when(_dfdcp_ok(s), who), "pair_key": _dfdcp_pair(s)}


# The release's names, folders and class numbers.
DFDCP = Release(
    "dfdc-p", "DFDC-P", "DFDCP",
    (
        Task("REAL", "Original", "real", "original_content/original/videos", "original", True),
        Task("FS_METHOD_A", "method_A", "fake", "manipulated_content/method_A/videos", "method_a", True),
        Task("FS_METHOD_B", "method_B", "fake", "manipulated_content/method_B/videos", "method_b", True),
    ),
    {
        "REAL": Label(0, 0, 1, "real"),
        "FS_METHOD_A": Label(1, 1, 2, "face-swap"),
        "FS_METHOD_B": Label(1, 1, 3, "face-swap"),
    },
    real=lambda: _same_person(F.when(parts(_stem(), "_") >= 3, part(_stem(), "_", 0))),
    fake=_dfdcp_fake,
    candidates=lambda: _dfdcp_pair(_local()),
    official=_local,
    pairing_rule="target-clip",
    default_scheme="official+ident-80-20",
    benchmark={"k_fake": 5, "strata": ("identity", "task")},
)

# --- DeeperForensics: <n>_<actor>, the same names in every version


def _after_first(s: Column) -> Column:
    return F.when(F.contains(s, F.lit("_")), F.substr(s, F.instr(s, "_") + 1))


# The release's names, folders and class numbers.
DEEPER = Release(
    "deeperforensics", "DeeperForensics-1.0", "DeFo",
    (
        Task("SR", "Source-Real", "real", "original_content/source_videos/videos", "original", True),
        Task("FS_E2E", "End-to-End", "fake", "manipulated_content/end_to_end/videos", "End-to-End"),
        Task("FS_L1", "E2E-Level-1", "fake", "manipulated_content/end_to_end_level_1/videos", "E2E-Level-1"),
        Task("FS_L2", "E2E-Level-2", "fake", "manipulated_content/end_to_end_level_2/videos", "E2E-Level-2"),
        Task("FS_L3", "E2E-Level-3", "fake", "manipulated_content/end_to_end_level_3/videos", "E2E-Level-3"),
        Task("FS_L4", "E2E-Level-4", "fake", "manipulated_content/end_to_end_level_4/videos", "E2E-Level-4"),
        Task("FS_L5", "E2E-Level-5", "fake", "manipulated_content/end_to_end_level_5/videos", "E2E-Level-5"),
        Task("FS_RND", "E2E-Random", "fake", "manipulated_content/end_to_end_random_level/videos", "E2E-Random"),
        Task("FS_M2", "E2E-Mix-2", "fake", "manipulated_content/end_to_end_mix_2_distortions/videos", "E2E-Mix-2"),
        Task("FS_M3", "E2E-Mix-3", "fake", "manipulated_content/end_to_end_mix_3_distortions/videos", "E2E-Mix-3"),
        Task("FS_M4", "E2E-Mix-4", "fake", "manipulated_content/end_to_end_mix_4_distortions/videos", "E2E-Mix-4"),
        Task("FR_RP", "Reenact-Post", "fake", "manipulated_content/reenact_postprocess/videos", "Reenact-Post"),
    ),
    {
        "SR": Label(0, 0, 1, "real"),
        "FS_E2E": Label(1, 1, 2, "face-swap"),
        "FS_L1": Label(1, 1, 3, "face-swap"),
        "FS_L2": Label(1, 1, 4, "face-swap"),
        "FS_L3": Label(1, 1, 5, "face-swap"),
        "FS_L4": Label(1, 1, 6, "face-swap"),
        "FS_L5": Label(1, 1, 7, "face-swap"),
        "FS_RND": Label(1, 1, 8, "face-swap"),
        "FS_M2": Label(1, 1, 9, "face-swap"),
        "FS_M3": Label(1, 1, 10, "face-swap"),
        "FS_M4": Label(1, 1, 11, "face-swap"),
        "FR_RP": Label(1, 1, 12, "face-reenactment"),
    },
    real=lambda: _same_person(part(_stem(), "_", 0)),
    fake=lambda: _same_person(_after_first(_stem())),
    candidates=lambda: F.when(_local().rlike(r"^\d+_[MW]\d+$"), _after_first(_local())),
    pairing_rule="identity-fanout",
    pairing_fanout=1,
    default_scheme="official",
    benchmark={"k_fake": 100, "strata": ("task",)},
)

# --- WildDeepfake: frame folders <label>_<split>_<shard>_<sequence>


def wild_split(key: Column) -> Column:
    named = part(key, "_", 1)
    return F.when(named.isin("train", "test"), named)


def _wild() -> dict[str, Column]:
    s = _stem()
    return {
        "attrs": F.create_map(
            F.lit("split"), wild_split(s),
            F.lit("shard"), part(s, "_", 2),
            F.lit("sequence"), part(s, "_", 3),
            F.lit("n_frames"), F.col("n_frames").cast("string"),
        )
    }


# The release's names, folders and class numbers.
WILD = Release(
    "wilddeepfake", "WildDeepfake", "WDF",
    (
        Task("REAL", "real", "real", "original_content/real/frames/224w_224h_wild_precropped", "original"),
        Task("FAKE", "fake", "fake", "manipulated_content/fake/frames/224w_224h_wild_precropped", "fake"),
    ),
    {
        "REAL": Label(0, 0, 1, "real"),
        "FAKE": Label(1, 1, 2, "unknown"),
    },
    real=_wild, fake=_wild,
    default_scheme="official+ident-80-20", benchmark={"k_fake": 100},
)

# --- FFIW-10K: the split is the name's prefix; pairs come from side lists

# The release's names, folders and class numbers.
FFIW = Release(
    "ffiw10k", "FFIW10K", "FFIW",
    (
        Task("REAL", "source", "real", "original_content/source/videos", "original"),
        Task("FS_FAKE", "target", "fake", "manipulated_content/target/videos", "unknown"),
    ),
    {
        "REAL": Label(0, 0, 1, "real"),
        "FS_FAKE": Label(1, 1, 2, "face-swap"),
    },
    real=lambda: {"identity": _stem()},
    fake=lambda: {"identity": _stem(), "pair_key": F.col("side.pair")},
    default_scheme="official", benchmark={"k_fake": 1000},
)

# --- KoDF: reals <actor>_<NNN>; fakes <target>_<source>_<code>_<seq>

# The method each code of a fake's name stands for.
KODF_CODES = {"1": "dfl", "2": "dffs", "3": "fsgan", "4": "fo", "5": "audio-driven"}


def _kodf_fake() -> dict[str, Column]:
    s = _stem()
    four = parts(s, "_") == 4
    code = part(s, "_", 2)
    method = F.coalesce(*[F.when(code == c, F.lit(m)) for c, m in KODF_CODES.items()])
    who = {**_same_person(part(s, "_", 0)), "source_id": part(s, "_", 1), "method": method}
    return _when(four, who)


# The release's names, folders and class numbers.
KODF = Release(
    "kodf", "KoDF", "KoDF",
    (
        Task("REAL", "Actors", "real", "original_content/actors/videos", "original", True),
        Task("LS_AD", "audio-driven", "fake", "manipulated_content/audio-driven/videos", "audio-driven", True),
        Task("FS_DFFS", "dffs", "fake", "manipulated_content/dffs/videos", "dffs", True),
        Task("FS_DFL", "dfl", "fake", "manipulated_content/dfl/videos", "dfl", True),
        Task("FR_FO", "fo", "fake", "manipulated_content/fo/videos", "fo", True),
        Task("FS_FSG", "fsgan", "fake", "manipulated_content/fsgan/videos", "fsgan", True),
    ),
    {
        "REAL": Label(0, 0, 1, "real"),
        "LS_AD": Label(1, 1, 2, "lip-sync"),
        "FS_DFFS": Label(1, 1, 3, "face-swap"),
        "FS_DFL": Label(1, 1, 4, "face-swap"),
        "FR_FO": Label(1, 1, 5, "face-reenactment"),
        "FS_FSG": Label(1, 1, 6, "face-swap"),
    },
    real=lambda: _same_person(
        F.when(F.contains(_stem(), F.lit("_")), F.regexp_extract(_stem(), "^(.*)_[^_]*$", 1))
    ),
    fake=_kodf_fake,
    candidates=lambda: F.when(parts(_local(), "_") == 4, part(_local(), "_", 0)),
    pairing_rule="identity-fanout",
    pairing_fanout=1,
    default_scheme="ident-72-14-14",
    benchmark={"k_fake": 2, "strata": ("target_id", "task")},
)

# --- DFDM: id<t>_id<s>_<rec>_<tag>


def _dfdm_ok(s: Column) -> Column:
    return s.rlike("^id[^_]*_id[^_]*_[^_]*_")


def _dfdm_pair(s: Column) -> Column:
    return F.when(_dfdm_ok(s), F.concat_ws("_", part(s, "_", 0), part(s, "_", 2)))


# The release's names, folders and class numbers.
DFDM = Release(
    "dfdm", "DFDM", "DFDM",
    (
        Task("REAL", "Celeb-real", "real", "original_content/Celeb-real/videos", "original"),
        Task("FS_DF", "DFaker", "fake", "manipulated_content/DFaker/{cX}/videos", "DFaker"),
        Task("FS_DFL", "DFL-H128", "fake", "manipulated_content/DFL-H128/{cX}/videos", "DFL-H128"),
        Task("FS_FS", "FaceSwap", "fake", "manipulated_content/FaceSwap/{cX}/videos", "FaceSwap"),
        Task("FS_IAE", "IAE", "fake", "manipulated_content/IAE/{cX}/videos", "IAE"),
        Task("FS_LW", "LightWeight", "fake", "manipulated_content/LightWeight/{cX}/videos", "LightWeight"),
    ),
    {
        "REAL": Label(0, 0, 1, "real"),
        "FS_DF": Label(1, 1, 2, "face-swap"),
        "FS_DFL": Label(1, 1, 3, "face-swap"),
        "FS_FS": Label(1, 1, 4, "face-swap"),
        "FS_IAE": Label(1, 1, 5, "face-swap"),
        "FS_LW": Label(1, 1, 6, "face-swap"),
    },
    real=lambda: _same_person(F.when(_stem().rlike("^id[^_]*_"), part(_stem(), "_", 0))),
    fake=lambda: {
        **_when(
            _dfdm_ok(_stem()),
            {**_same_person(part(_stem(), "_", 0)), "source_id": part(_stem(), "_", 1)},
        ),
        "pair_key": _dfdm_pair(_stem()),
    },
    candidates=lambda: _dfdm_pair(_local()),
    compressions=("c0", "c10", "c23"),
    pairing_rule="target-recording",
    default_scheme="ident-72-14-14",
    benchmark={"k_fake": 50, "strata": ("task",)},
)

# --- FakeAVCeleb: keyed by the sanitised path; metadata by the same key


def _path_key(path: Column) -> Column:
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    return F.array_join(F.transform(F.split(bare, "/"), sanitised), "__")


def _favc(kind: str) -> Callable[[], dict[str, Column]]:
    def columns() -> dict[str, Column]:
        key = _path_key(F.col("below"))
        person = F.when(
            parts(key, "__") >= 3, F.array_join(F.slice(F.split(key, "__"), 1, 3), "__")
        ).otherwise(key)
        person = F.nullif(person, F.lit(""))
        known = F.col("side.source").isNotNull()
        donor = F.when(F.startswith("side.target1", F.lit("id")), F.col("side.target1"))
        bare = null()
        if kind == "fake":
            bare = F.when(F.endswith(key, F.lit("__fake")), F.regexp_extract(key, "^(.*)__fake$", 1))
        raw = F.when(known, F.col("side.raw_video_stem")).otherwise(bare)
        return {
            "key": key,
            "identity": person,
            "target_id": F.when(known, F.col("side.source")).otherwise(person),
            "source_id": donor,
            "pair_key": raw,
            "method": F.col("side.method"),
            "attrs": F.create_map(
                F.lit("raw_video_stem"), raw, F.lit("category"), F.col("side.category")
            ),
        }

    return columns


# Tasks and class numbers that two releases share.
_AV_TASKS = (
    Task("RVRA", "RealVideo-RealAudio", "real", "original_content/RealVideo-RealAudio/videos", "original", True),
    Task("FVFA", "FakeVideo-FakeAudio", "fake", "manipulated_content/FakeVideo-FakeAudio/videos", "FakeVideo-FakeAudio", True),
    Task("FVRA", "FakeVideo-RealAudio", "fake", "manipulated_content/FakeVideo-RealAudio/videos", "FakeVideo-RealAudio", True),
    Task("RVFA", "RealVideo-FakeAudio", "fake", "manipulated_content/RealVideo-FakeAudio/videos", "RealVideo-FakeAudio", True),
)
_AV_LABELS = {
    "RVRA": Label(0, 0, 1, "real"),
    "FVFA": Label(1, 1, 2, "video-and-audio"),
    "FVRA": Label(1, 1, 3, "video-only"),
    "RVFA": Label(0, 1, 1, "audio-only"),
}
# The release's names, folders and class numbers.
FAVC = Release(
    "fakeavceleb", "FakeAVCeleb-v1_2", "FAVC", _AV_TASKS, _AV_LABELS,
    real=_favc("real"), fake=_favc("fake"),
    candidates=lambda: F.coalesce(
        F.nullif(F.element_at("attrs", F.lit("raw_video_stem")), F.lit("")), _strip_fake(_local())
    ),
    pairing_rule="target-recording",
    default_scheme="ident-72-14-14",
    benchmark={"k_fake": 2, "strata": ("source_id", "task")},
)

# --- PolyGlotFake: <src>_<n>_to_<lang>_<tts>; speakers from metadata

LANGUAGES = ("ar", "en", "es", "fr", "ja", "ru", "zh")


def dub_real(s: Column) -> Column:
    """The real clip a dub names; null for a name without `_to_`, empty when nothing precedes it."""
    return F.when(F.contains(s, F.lit("_to_")), F.substring_index(s, "_to_", 1))


def _pgf_fake() -> dict[str, Column]:
    s = _stem()
    dubbed = F.contains(s, F.lit("_to_"))
    real = dub_real(s)
    after = F.substr(s, F.instr(s, "_to_") + 4)
    folder_lang = F.replace(F.col("task"), F.lit("to_"), F.lit(""))
    source = part(real, "_", 0)
    return {
        "identity": F.coalesce("side.speaker", source),
        "target_id": F.when(dubbed, part(after, "_", 0)).otherwise(folder_lang),
        "source_id": source,
        "pair_key": real,
    }


# The release's names, folders and class numbers.
PGF = Release(
    "polyglotfake", "PolyGlotFake", "PGF",
    (
        Task("AR", "ar", "real", "original_content/ar/videos", "original"),
        Task("EN", "en", "real", "original_content/en/videos", "original"),
        Task("ES", "es", "real", "original_content/es/videos", "original"),
        Task("FR", "fr", "real", "original_content/fr/videos", "original"),
        Task("JA", "ja", "real", "original_content/ja/videos", "original"),
        Task("RU", "ru", "real", "original_content/ru/videos", "original"),
        Task("ZH", "zh", "real", "original_content/zh/videos", "original"),
        Task("LS_TO_AR", "to_ar", "fake", "manipulated_content/to_ar/videos", "lip_sync"),
        Task("LS_TO_EN", "to_en", "fake", "manipulated_content/to_en/videos", "lip_sync"),
        Task("LS_TO_ES", "to_es", "fake", "manipulated_content/to_es/videos", "lip_sync"),
        Task("LS_TO_FR", "to_fr", "fake", "manipulated_content/to_fr/videos", "lip_sync"),
        Task("LS_TO_JA", "to_ja", "fake", "manipulated_content/to_ja/videos", "lip_sync"),
        Task("LS_TO_RU", "to_ru", "fake", "manipulated_content/to_ru/videos", "lip_sync"),
        Task("LS_TO_ZH", "to_zh", "fake", "manipulated_content/to_zh/videos", "lip_sync"),
    ),
    {
        "AR": Label(0, 0, 1, "real"),
        "EN": Label(0, 0, 1, "real"),
        "ES": Label(0, 0, 1, "real"),
        "FR": Label(0, 0, 1, "real"),
        "JA": Label(0, 0, 1, "real"),
        "RU": Label(0, 0, 1, "real"),
        "ZH": Label(0, 0, 1, "real"),
        "LS_TO_AR": Label(1, 1, 2, "lip-sync"),
        "LS_TO_EN": Label(1, 1, 3, "lip-sync"),
        "LS_TO_ES": Label(1, 1, 4, "lip-sync"),
        "LS_TO_FR": Label(1, 1, 5, "lip-sync"),
        "LS_TO_JA": Label(1, 1, 6, "lip-sync"),
        "LS_TO_RU": Label(1, 1, 7, "lip-sync"),
        "LS_TO_ZH": Label(1, 1, 8, "lip-sync"),
    },
    real=lambda: {
        "identity": F.coalesce("side.speaker", "task"),
        "target_id": F.col("task"),
    },
    fake=_pgf_fake,
    candidates=lambda: F.nullif(dub_real(_local()), F.lit("")),
    pairing_rule="strip-to-suffix",
    default_scheme="ident-72-14-14",
    benchmark={"k_fake": 15, "strata": ("target_id", "source_id", "task")},
)

# --- DeepSpeak v1 and v2: actors in the name, or in the annotations


def _ds_real() -> dict[str, Column]:
    return _same_person(F.when(parts(_stem(), "-") >= 2, part(_stem(), "-", 0)))


def _ds1_fake() -> dict[str, Column]:
    s = _stem()
    actors, recordings = part(s, "--", 1), part(s, "--", 2)
    ok = (parts(s, "--") >= 3) & (parts(actors, "-") >= 2) & (parts(recordings, "-") >= 2)
    target = part(actors, "-", 1)
    return _when(
        ok,
        {
            **_same_person(target),
            "source_id": part(actors, "-", 0),
            "pair_key": F.concat_ws("-", target, part(recordings, "-", 1)),
        },
    )


def _ds2_fake() -> dict[str, Column]:
    s = _stem()
    known = F.col("side.listed").isNotNull()
    target, recording = F.col("side.target"), F.col("side.recording")
    both = target.isNotNull() & recording.isNotNull()
    engine = F.when(known, F.col("side.engine")).otherwise(
        F.when(parts(s, "-") >= 3, part(s, "-", 0))
    )
    audio = F.when(known, F.col("side.audio_config")).otherwise(part(s, "-", 3))
    return {
        **_same_person(target),
        "source_id": F.col("side.source"),
        "pair_key": F.when(both, F.concat_ws("-", target, recording)),
        "attrs": F.create_map(F.lit("engine"), engine, F.lit("audio_config"), audio),
    }


def _deepspeak(
    version: str, tasks: tuple[Task, ...], labels: Mapping[str, Label], fake: Callable, benchmark: dict
) -> Release:
    return Release(
        f"deepspeak-{version}", f"DeepSpeak-{version}", f"DS{version}", tasks, labels,
        real=_ds_real, fake=fake,
        candidates=lambda: F.coalesce("pair_key", "target_id"),
        official=lambda: F.nullif("identity", F.lit("")),
        pairing_rule="target-recording", default_scheme="official+ident-80-20", benchmark=benchmark,
    )


# The release's names, folders and class numbers.
DEEPSPEAK_V1 = _deepspeak(
    "v1",
    (
        Task("AR", "Actors", "real", "original_content/Actors/videos", "original"),
        Task("FS_FF", "FaceFusion", "fake", "manipulated_content/FaceFusion/videos", "facefusion"),
        Task("FS_FFGAN", "FaceFusion_GAN", "fake", "manipulated_content/FaceFusion_GAN/videos", "facefusion_gan"),
        Task("FS_FFLIVE", "FaceFusion_Live", "fake", "manipulated_content/FaceFusion_Live/videos", "facefusion_live"),
        Task("LS_RT", "ReTalking", "fake", "manipulated_content/ReTalking/videos", "retalking"),
        Task("LS_W2L", "Wav2Lip", "fake", "manipulated_content/Wav2Lip/videos", "wav2lip"),
    ),
    {
        "AR": Label(0, 0, 1, "real"),
        "FS_FF": Label(1, 1, 2, "face-swap"),
        "FS_FFGAN": Label(1, 1, 3, "face-swap"),
        "FS_FFLIVE": Label(1, 1, 4, "face-swap"),
        "LS_RT": Label(1, 1, 5, "lip-sync"),
        "LS_W2L": Label(1, 1, 6, "lip-sync"),
    },
    _ds1_fake, {"k_fake": 2, "strata": ("identity", "task")},
)
# The release's names, folders and class numbers.
DEEPSPEAK_V2 = _deepspeak(
    "v2",
    (
        Task("AR", "Actors", "real", "original_content/Actors/videos", "original"),
        Task("LS_D2L", "Diff2Lip", "fake", "manipulated_content/Diff2Lip/videos", "diff2lip"),
        Task("FS_FF", "FaceFusion", "fake", "manipulated_content/FaceFusion/videos", "facefusion"),
        Task("TF_HM", "HelloMeme", "fake", "manipulated_content/HelloMeme/videos", "hellomeme"),
        Task("LS_LS", "LatentSync", "fake", "manipulated_content/LatentSync/videos", "latentsync"),
        Task("TF_LP", "LivePortrait", "fake", "manipulated_content/LivePortrait/videos", "liveportrait"),
        Task("TF_MEMO", "Memo", "fake", "manipulated_content/Memo/videos", "memo"),
    ),
    {
        "AR": Label(0, 0, 1, "real"),
        "LS_D2L": Label(1, 1, 2, "lip-sync"),
        "FS_FF": Label(1, 1, 3, "face-swap"),
        "TF_HM": Label(1, 1, 4, "talking-face"),
        "LS_LS": Label(1, 1, 5, "lip-sync"),
        "TF_LP": Label(1, 1, 6, "talking-face"),
        "TF_MEMO": Label(1, 1, 7, "talking-face"),
    },
    _ds2_fake, {"k_fake": 2, "strata": ("target_id", "task")},
)

# --- IDForge: <session>__<stem>, the person is the name's id<digits>


def _idforge(kind: str) -> Callable[[], dict[str, Column]]:
    def columns() -> dict[str, Column]:
        person = F.nullif(F.regexp_extract(_stem(), r"^(id\d+)", 1), F.lit(""))
        session = F.element_at(F.split("relpath", "/"), -2)
        out = {**_same_person(person), "key": F.concat_ws("__", session, _stem())}
        return {**out, "pair_key": person} if kind == "fake" else out

    return columns


# The release's names, folders and class numbers.
IDFORGE = Release(
    "idforge-v1", "IDForge-v1", "IDFv1",
    (
        Task("REAL", "pristine", "real", "original_content/pristine/videos", "original", True),
        Task("FS_AM_TM", "face_audiomismatch_textmismatch", "fake", "manipulated_content/face_audiomismatch_textmismatch/videos", "face_audiomismatch_textmismatch", True),
        Task("FS_RVC_TM", "face_rvc_textmismatch", "fake", "manipulated_content/face_rvc_textmismatch/videos", "face_rvc_textmismatch", True),
        Task("FS_TTS", "face_tts", "fake", "manipulated_content/face_tts/videos", "face_tts", True),
        Task("FS_TTS_TG", "face_tts_textgen", "fake", "manipulated_content/face_tts_textgen/videos", "face_tts_textgen", True),
        Task("LS_AM_TM", "lip_audiomismatch_textmismatch", "fake", "manipulated_content/lip_audiomismatch_textmismatch/videos", "lip_audiomismatch_textmismatch", True),
        Task("LS_RVC_TM", "lip_rvc_textmismatch", "fake", "manipulated_content/lip_rvc_textmismatch/videos", "lip_rvc_textmismatch", True),
        Task("LS_TTS_TG", "lip_tts_textgen", "fake", "manipulated_content/lip_tts_textgen/videos", "lip_tts_textgen", True),
        Task("RVC_TM", "rvc_textmismatch", "fake", "manipulated_content/rvc_textmismatch/videos", "rvc_textmismatch", True),
        Task("TTS_TG", "tts_textgen", "fake", "manipulated_content/tts_textgen/videos", "tts_textgen", True),
        Task("TTS_TM", "tts_textmismatch", "fake", "manipulated_content/tts_textmismatch/videos", "tts_textmismatch", True),
    ),
    {
        "REAL": Label(0, 0, 1, "real"),
        "FS_AM_TM": Label(1, 1, 2, "face-swap"),
        "FS_RVC_TM": Label(1, 1, 3, "face-swap"),
        "FS_TTS": Label(1, 1, 4, "face-swap"),
        "FS_TTS_TG": Label(1, 1, 5, "face-swap"),
        "LS_AM_TM": Label(1, 1, 6, "lip-sync"),
        "LS_RVC_TM": Label(1, 1, 7, "lip-sync"),
        "LS_TTS_TG": Label(1, 1, 8, "lip-sync"),
        "RVC_TM": Label(0, 1, 1, "audio-only"),
        "TTS_TG": Label(0, 1, 1, "audio-only"),
        "TTS_TM": Label(0, 1, 1, "audio-only"),
    },
    real=_idforge("real"), fake=_idforge("fake"),
    candidates=lambda: F.col("identity"),
    official=_local,
    pairing_rule="identity-fanout",
    pairing_fanout=1,
    default_scheme="official",
    benchmark={
        "k_fake": 5, "strata": ("identity", "task"), "exclude_tasks": ("RVC_TM", "TTS_TG", "TTS_TM"),
    },
)

# --- LAV-DF: everything comes from the metadata row of the stem

_LAV_FIELDS = (
    "n_fakes", "fake_periods", "modify_video", "modify_audio", "duration", "video_frames",
    "audio_channels", "audio_frames",
)


def _lav() -> dict[str, Column]:
    defaults = {"n_fakes": F.lit("0"), "fake_periods": F.lit("[]")}
    entries = []
    for f in _LAV_FIELDS:
        entries += [F.lit(f), F.coalesce(F.col(f"side.{f}"), defaults.get(f, null()))]
    return {"pair_key": F.col("side.original"), "attrs": F.create_map(*entries)}


# The release's names, folders and class numbers.
LAVDF = Release(
    "lav-df", "LAV-DF", "LAVDF", _AV_TASKS, _AV_LABELS,
    real=_lav, fake=_lav, candidates=lambda: F.col("pair_key"), official=_local,
    pairing_rule="original-video", default_scheme="official",
    benchmark={"k_fake": 100, "strata": ("task",)},
)

# --- AV-Deepfake1M++: records are metadata rows, see `inventory.metadata_records`

CORPORA = {"vox_celeb_2": "vox2", "lrs3": "lrs3", "silent_videos": "silent"}
# The task of each (modify_type, video_model).
AVDF_TASKS = {
    ("real", None): "RVRA",
    ("audio_modified", None): "RVFA",
    ("visual_modified", "Talklip"): "LS_TALKLIP",
    ("visual_modified", "diff2lip"): "LS_D2L",
    ("both_modified", "Talklip"): "LS_TALKLIP_TTS",
}
# The release's names, folders and class numbers.
AVDF = Release(
    "av-deepfake1m-pp", "AV-Deepfake1M++", "AVDF1MPP",
    (
        Task("RVRA", "RealVideo-RealAudio", "real", "", "original", True),
        Task("LS_TALKLIP", "FakeVideo-RealAudio-Talklip", "fake", "", "Talklip", True),
        Task("LS_TALKLIP_TTS", "FakeVideo-FakeAudio-Talklip", "fake", "", "Talklip", True),
        Task("LS_D2L", "FakeVideo-RealAudio-Diff2Lip", "fake", "", "diff2lip", True),
        Task("RVFA", "RealVideo-FakeAudio", "fake", "", "tts_audio_only", True),
    ),
    {
        "RVRA": Label(0, 0, 1, "real"),
        "LS_TALKLIP": Label(1, 1, 2, "lip-sync"),
        "LS_TALKLIP_TTS": Label(1, 1, 3, "lip-sync"),
        "LS_D2L": Label(1, 1, 4, "lip-sync"),
        "RVFA": Label(0, 1, 1, "audio-only"),
    },
    candidates=lambda: F.col("pair_key"), official=_local, pairing_rule="original-video",
    default_scheme="official", benchmark={"k_fake": 100, "strata": ("task",)},
    local_attrs=("audio_relpath",),
)

# --- TalkingHeadBench: reals from the list, fakes by their driver


def thb_driver(stem: Column, task: Column) -> Column:
    """The driving clip a fake's name gives, before a lost leading dash is restored."""
    after = F.when(F.contains(stem, F.lit("-")), F.substr(stem, F.instr(stem, "-") + 1))
    three = F.when(parts(stem, "--") == 3, part(stem, "--", 1))
    return F.when(task == "Hallo3", after).when(task != "MAGI-1", three)


def _thb_fake() -> dict[str, Column]:
    written = thb_driver(_stem(), F.col("task"))
    return {"source_id": F.coalesce("side.driver", written)}


# The sibling folder and video folder of each task of reals.
THB_REALS = {
    "REAL_FF": ("FaceForensics++", "original_content/YouTube/raw/videos"),
    "REAL_CVHQ": ("CelebV-HQ", "original_content/YouTube/videos"),
}
THB_HELD_OUT = ("TH_M1", "TH_H3")
# The release's names, folders and class numbers.
THB = Release(
    "talkingheadbench", "TalkingHeadBench", "THB",
    (
        Task("REAL_FF", "Real-FFpp", "real", "../FaceForensics++/original_content/YouTube/raw/videos", "original"),
        Task("REAL_CVHQ", "Real-CelebVHQ", "real", "../CelebV-HQ/original_content/YouTube/videos", "original"),
        Task("TH_LP", "LivePortrait", "fake", "manipulated_content/LivePortrait/videos", "LivePortrait"),
        Task("TH_APA", "AniPortraitAudio", "fake", "manipulated_content/AniPortraitAudio/videos", "AniPortraitAudio"),
        Task("TH_APV", "AniPortraitVideo", "fake", "manipulated_content/AniPortraitVideo/videos", "AniPortraitVideo"),
        Task("TH_H1", "Hallo", "fake", "manipulated_content/Hallo/videos", "Hallo"),
        Task("TH_H2", "Hallo2", "fake", "manipulated_content/Hallo2/videos", "Hallo2"),
        Task("TH_EP", "EmoPortrait", "fake", "manipulated_content/EmoPortrait/videos", "EmoPortrait"),
        Task("TH_M1", "MAGI-1", "fake", "manipulated_content/MAGI-1/videos", "MAGI-1"),
        Task("TH_H3", "Hallo3", "fake", "manipulated_content/Hallo3/videos", "Hallo3"),
    ),
    {
        "REAL_FF": Label(0, 0, 1, "real"),
        "REAL_CVHQ": Label(0, 0, 1, "real"),
        "TH_LP": Label(1, 1, 2, "talking-head"),
        "TH_APA": Label(1, 1, 3, "talking-head"),
        "TH_APV": Label(1, 1, 4, "talking-head"),
        "TH_H1": Label(1, 1, 5, "talking-head"),
        "TH_H2": Label(1, 1, 6, "talking-head"),
        "TH_EP": Label(1, 1, 7, "talking-head"),
        "TH_M1": Label(1, 1, 8, "talking-head"),
        "TH_H3": Label(1, 1, 9, "talking-head"),
    },
    fake=_thb_fake, candidates=lambda: F.col("source_id"), pairing_rule="driving-video",
    default_scheme="official", benchmark={"k_fake": 100, "strata": ("task",)},
    local_attrs=("audio_relpath",),
)

# --- A synthetic release: <target>_<source>, split by identity


def _synthetic_fake() -> dict[str, Column]:
    ok = _stem().rlike("^[^_]+_[^_]+$")
    target = part(_stem(), "_", 0)
    return _when(
        ok, {**_same_person(target), "source_id": part(_stem(), "_", 1), "pair_key": target}
    )


# The release's names, folders and class numbers.
SYNTHETIC = Release(
    "synthetic", "synthetic", "SYN",
    (
        Task("REAL", "original", "real", "original", "original"),
        Task("BLEND_A", "blend-a", "fake", "blend-a", "blend-a"),
        Task("BLEND_B", "blend-b", "fake", "blend-b", "blend-b"),
    ),
    {
        "REAL": Label(0, 0, 0, "real"),
        "BLEND_A": Label(1, 1, 1, "blend"),
        "BLEND_B": Label(1, 1, 2, "blend"),
    },
    real=lambda: _same_person(_stem()), fake=_synthetic_fake,
    candidates=lambda: F.col("target_id"), official=lambda: F.col("identity"),
    pairing_rule="target-id", default_scheme="official", benchmark={"k_fake": 20},
)

RELEASES: dict[str, Release] = {
    r.dataset: r
    for r in (
        FFPP, DFD, UADFV, CELEBDF_V1, CELEBDF_V2, CELEBDF_V3, DFDC, DFDCP, DEEPER, WILD, FFIW, KODF,
        DFDM, FAVC, PGF, DEEPSPEAK_V1, DEEPSPEAK_V2, IDFORGE, LAVDF, AVDF, THB, SYNTHETIC,
    )
}
