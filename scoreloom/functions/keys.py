"""Expressions over record keys: parts, hashes, paths."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the identity carves, in hundredths of the md5 space.
VAL_72_14_14 = 14
TEST_72_14_14 = 28
VAL_80_20 = 20

# An absolute path at the start of a text or after a separator, or a file address;
# folders that give a local machine away wherever they stand; and web addresses, which are neither.
ABSOLUTE_PATH = r"(?:^|[\s=:,;\"'(])(?:~/|/(?:[^/\s]|$))|file:///"
LOCAL_ROOTS = ("home", "mnt", "media", "Users", "scratch", "data")
LOCAL_PATH = "|".join(f"/{root}/" for root in LOCAL_ROOTS) + r"|C:\\|~/"
WEB_ADDRESS = r"https?://[^\s\"'<>()\[\]]+"


def task_of(key: Column) -> Column:
    """The part before the first slash; empty when there is none."""
    return F.when(F.instr(key, "/") > 0, F.substring_index(key, "/", 1)).otherwise(F.lit(""))


def task_or_key(key: Column) -> Column:
    """The part before the first slash; the whole key when there is none."""
    return F.substring_index(key, "/", 1)


def local_key(key: Column) -> Column:
    """The part after the first slash; the whole key when there is none."""
    at = F.instr(key, "/")
    return F.when(at > 0, F.substr(key, at + 1)).otherwise(key)


def carve_key(key: Column, identity: Column) -> Column:
    """What a carve hashes: the identity when there is one, else the local key."""
    return F.coalesce(F.nullif(identity, F.lit("")), local_key(key))


def md5_mod(text: Column, modulus: int) -> Column:
    """The md5 of a text, read as one 128-bit number, modulo `modulus`.

    Taken 32 bits at a time: carrying the remainder keeps every step inside 64 bits.
    """
    digest = F.md5(text)
    carried = F.lit(0).cast("long")
    shift = (1 << 32) % modulus
    for word in range(4):
        bits = F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("long")
        carried = F.pmod(carried * F.lit(shift).cast("long") + bits, F.lit(modulus).cast("long"))
    return carried.cast("int")


def shard_of(key: Column, compression: Column, shards: int) -> Column:
    return md5_mod(F.concat(key, F.lit("|"), F.coalesce(compression, F.lit(""))), shards)


def _leading_64_bits(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_uniform(
    seed: Column | int, dataset: Column, key: Column, compression: Column
) -> Column:
    """A score in [0, 1) that depends on nothing but the seed and the row's key."""
    seed_text = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    text = F.concat_ws("|", seed_text, dataset, key, F.coalesce(compression, F.lit("")))
    return _leading_64_bits(text).cast("double") / F.lit(float(2**64))


def draw_seed(seed: Column | int, epoch: Column | int, *more: Column | int) -> Column:
    """The 64-bit seed of one epoch's (or one item's) draws."""
    parts = [F.lit(str(p)) if isinstance(p, int) else p.cast("string") for p in (seed, epoch, *more)]
    return _leading_64_bits(F.concat_ws(":", *parts))


def stem_of(path: Column) -> Column:
    """The file name of a path without its last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def sanitised(text: Column) -> Column:
    """Runs of anything but letters and digits become one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), F.lit("_"))


def slug(text: Column) -> Column:
    """Lower-case words joined by dashes; `x` when nothing is left."""
    kebab = F.btrim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(kebab, F.lit("")), F.lit("x"))


def video_relpath(key: Column, compression: Column) -> Column:
    return F.concat(key, F.lit("/"), F.coalesce(compression, F.lit("_")))


def has_absolute_path(text: Column) -> Column:
    return text.rlike(ABSOLUTE_PATH)


def leaks_local_path(text: Column) -> Column:
    """An absolute path, or a local folder named anywhere outside a web address."""
    return has_absolute_path(text) | F.regexp_replace(text, WEB_ADDRESS, " ").rlike(LOCAL_PATH)


# Fixed value: an absolute path inside free text; group 1 is what leads it, group 2 its last part.
PATH_IN_TEXT = (
    r"(^|[\s=:,;\"'(]|(?=file:///))(?:file://)?(?:~/|/(?![/\s]))"
    r"(?:[^\s\"')\]/]*/+)*?([^\s\"')\]/]*)/*(?=[\s\"')\]]|$)"
)


def portable_text(text: Column) -> Column:
    """Free text with every absolute path cut to its last part."""
    return F.regexp_replace(text, PATH_IN_TEXT, "$1$2")


def expand_compressions(folder: Column, known: Sequence[str], requested: Iterable[str]) -> Column:
    """Structs (compression, folder) of a `{cX}` folder pattern, in the known order.

    A pattern without the placeholder is one folder with a null compression.
    """
    wanted = set(requested)
    unknown = wanted - set(known)
    if unknown:
        raise ValueError(f"unknown compression {sorted(unknown)[0]!r}; known: {', '.join(known)}")
    each = F.array(
        *[
            F.struct(
                F.lit(c).alias("compression"),
                F.replace(folder, F.lit("{cX}"), F.lit(c)).alias("folder"),
            )
            for c in known
            if c in wanted
        ]
    )
    plain = F.array(
        F.struct(F.lit(None).cast("string").alias("compression"), folder.alias("folder"))
    )
    return F.when(F.contains(folder, F.lit("{cX}")), each).otherwise(plain)


def hash_pick(text: Column, count: Column) -> Column:
    """A 0-based pick out of `count`, uniform over texts: 60 bits of the md5, modulo."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % count
