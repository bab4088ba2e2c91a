"""Streams: the outcome log's latest rows, live coverage, and tracking frame by frame.

Every stream writes its updates through `foreachBatch`, one folder per batch that a retried batch
overwrites, so each update lands exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scoreloom.operators.logs import latest
from scoreloom.operators.records import KEY
from scoreloom.operators.track import SMOOTHING_GAP, Frame, TrackSpec


def latest_stream(log: DataFrame, keys: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """The last outcome per key as the log grows; state is one row per key."""
    others = [c for c in log.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.col(seq)).alias("_row")
    return log.groupBy(*keys).agg(best).select(*keys, "_row.*")


def live_coverage(rows: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Counts by status of a score table that is still being written."""
    return rows.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))


def write_updates(
    stream: DataFrame, path: str, checkpoint: str, *, mode: str = "update"
) -> StreamingQuery:
    """Run a stream over what is there now, writing each batch of updates under `path`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{path}/batch-{batch_id:09d}"
        )

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest update of every key."""
    rows = spark.read.parquet(f"{path}/batch-*")
    return latest(rows, keys, "batch_id").drop("batch_id")


TRACK_OUTPUT = (
    "frame long, x1 double, y1 double, x2 double, y2 double, score double, reason string,"
    " jumped boolean, late long"
)
_STATE = (
    "raw array<double>, smooth array<double>, last_good long, last long, switched boolean, late long"
)


def track_stream(frames: DataFrame, key: str, spec: TrackSpec) -> DataFrame:
    """The tracker with its state kept per video between batches.

    State is two boxes, two frame numbers, the switch flag and the count of late frames. A frame
    that is not after the last one seen changes nothing; its row says so, and `late` counts them.
    With `spec.ema` set, boxes are smoothed as they come.
    """
    key_type = dict(frames.dtypes)[key]

    def step(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.exists:
            raw, smooth, last_good, last, switched, late = state.get
        else:
            raw, smooth, last_good, last, switched, late = None, None, None, None, False, 0
        raw = None if raw is None else tuple(raw)
        smooth = None if smooth is None else np.asarray(smooth, dtype=float)
        rows = pd.concat(list(batches)).sort_values("frame")
        out = []
        for index, faces in zip(rows["frame"], rows["faces"], strict=True):
            index = int(index)
            if last is not None and index <= last:
                late += 1
                out.append((group[0], index, *(None,) * 5, "late frame", False, late))
                continue
            last = index
            frame = Frame(index, list(faces), None, spec)
            at, jumped = frame.choose(raw, spec)
            box = (None,) * 4
            score = None
            if at >= 0:
                raw, score = frame.boxes[at], frame.scores[at]
                now = np.asarray(raw, dtype=float)
                if spec.ema is not None:
                    fresh = smooth is None or index - last_good > SMOOTHING_GAP
                    smooth = now if fresh else spec.ema * now + spec.keep * smooth
                    now = smooth
                last_good, box = index, tuple(float(v) for v in now)
                switched = switched or jumped
            out.append((group[0], index, *box, score, frame.reason, jumped, late))
        state.update(
            (
                None if raw is None else [float(v) for v in raw],
                None if smooth is None else [float(v) for v in smooth],
                last_good, last, switched, late,
            )
        )
        names = [key, "frame", "x1", "y1", "x2", "y2", "score", "reason", "jumped", "late"]
        yield pd.DataFrame(out, columns=names)

    return frames.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {key_type}, {TRACK_OUTPUT}", _STATE, "append", GroupStateTimeout.NoTimeout
    )
