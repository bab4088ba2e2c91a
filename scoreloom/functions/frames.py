"""Expressions over frame positions and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.errors import ConfigError


def spaced(last: Column, count: int) -> Column:
    """`count` whole positions evenly spread over 0..`last`, both ends included.

    Truncated like an integer linspace: position i is i times a double step.
    """
    if count == 1:
        return F.array(F.lit(0).cast("int"))
    step = last.cast("double") / F.lit(float(count - 1))
    steps = F.sequence(F.lit(0), F.lit(count - 1))
    return F.transform(
        steps,
        lambda i: F.when(i == count - 1, last.cast("int")).otherwise(
            F.floor(i.cast("double") * step).cast("int")
        ),
    )


def sample_indices(
    mode: str, total: Column, *, frames: int | None = None, stride: int | None = None
) -> Column:
    """The ascending frame numbers a sampling mode picks out of `total` frames."""
    if mode == "all":
        picked = F.sequence(F.lit(0), total.cast("int") - 1)
    elif mode == "uniform":
        if frames is None:
            raise ConfigError("uniform sampling needs `frames`")
        picked = F.array_distinct(spaced(total - 1, frames))
    elif mode == "first-consecutive":
        if frames is None:
            raise ConfigError("first-consecutive sampling needs `frames`")
        picked = F.sequence(F.lit(0), F.least(F.lit(frames), total.cast("int")) - 1)
    elif mode == "stride":
        if stride is None:
            raise ConfigError("stride sampling needs `stride`")
        picked = F.sequence(F.lit(0), total.cast("int") - 1, F.lit(stride))
    else:
        raise ConfigError(f"unknown sampling mode {mode!r}")
    return F.when(total > 0, picked).otherwise(F.array().cast("array<int>"))


def eval_clips(
    stored: Column, *, frames: int, clips: int, sampling: str = "uniform", stride: int = 1
) -> Column:
    """Clips of a video as structs (clip_index, positions, padded) over its stored frames."""
    indices = F.sequence(F.lit(0), F.lit(clips - 1))
    if sampling == "uniform":
        spread = spaced(stored - 1, clips * frames)
        return F.transform(
            indices,
            lambda c: F.struct(
                c.alias("clip_index"),
                F.slice(spread, c * frames + 1, F.lit(frames)).alias("positions"),
                F.lit(False).alias("padded"),
            ),
        )
    if sampling not in ("consecutive", "random-window"):
        raise ConfigError(f"unknown clip sampling {sampling!r}")
    starts = spaced(F.greatest(stored - frames * stride, F.lit(0)), clips)
    steps = F.sequence(F.lit(0), F.lit(frames - 1))

    def one(c: Column) -> Column:
        start = F.get(starts, c)
        return F.struct(
            c.alias("clip_index"),
            F.transform(
                steps, lambda k: F.least(start + k * stride, stored.cast("int") - 1)
            ).alias("positions"),
            (start + (frames - 1) * stride >= stored).alias("padded"),
        )

    return F.transform(indices, one)


def crop_box(
    x1: Column, y1: Column, x2: Column, y2: Column, *, scale: float, width: Column, height: Column
) -> Column:
    """The square around a face box, with its padding; null when it is empty.

    Edges are cut towards zero, as an integer cast does.
    """
    side = F.greatest(x2 - x1, y2 - y1) * F.lit(float(scale))
    cx, cy = (x1 + x2) / 2.0, (y1 + y2) / 2.0
    left, top = (cx - side / 2.0).cast("int"), (cy - side / 2.0).cast("int")
    right, bottom = (cx + side / 2.0).cast("int"), (cy + side / 2.0).cast("int")
    zero = F.lit(0)
    box = F.struct(
        left.alias("x1"),
        top.alias("y1"),
        right.alias("x2"),
        bottom.alias("y2"),
        side.alias("side"),
        F.greatest(zero, -left).alias("pad_left"),
        F.greatest(zero, -top).alias("pad_top"),
        F.greatest(zero, right - width).alias("pad_right"),
        F.greatest(zero, bottom - height).alias("pad_bottom"),
    )
    return F.when((right > left) & (bottom > top), box)


def map_landmarks(points: Column, box: Column, size: int) -> Column:
    """Points of the frame in the coordinates of a crop resized to `size`."""
    ratio = F.lit(float(size)) / box["side"]
    return F.transform(
        points,
        lambda p: F.struct(
            ((p["x"] - box["x1"]) * ratio).alias("x"), ((p["y"] - box["y1"]) * ratio).alias("y")
        ),
    )


def box_area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def box_iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes over their union; zero when the union is empty."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = box_area(a) + box_area(b) - w * h
    return F.when(union == 0.0, zero).otherwise(w * h / F.nullif(union, zero))
