"""Small table shapes shared by sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_rows(clips: DataFrame, keys: Sequence[str], frames: str = "frame_indices") -> DataFrame:
    """One row per frame of a clip, in the clip's order."""
    others = [c for c in clips.columns if c != frames]
    return clips.select(*others, F.posexplode(frames).alias("step", "frame_index"))
