"""Batch scoring of clips with any Python scorer, and reuse of finished results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.errors import ContractError
from scoreloom.operators.coverage import clip_to_video
from scoreloom.operators.joins import ROW_KEY
from scoreloom.operators.ordered import join_null_safe
from scoreloom.session import cut_lineage

# Clips of one video that are kept in one task.
VIDEO_RUN = 64

# A scorer takes a batch of clip rows and returns one score in [0, 1] per row.
Scorer = Callable[[pd.DataFrame], Sequence[float]]


def constant_scorer(value: float = 0.5) -> Scorer:
    return lambda batch: np.full(len(batch), value)


def load_scorer(reference: str) -> Scorer:
    """A scorer from a `module:factory` reference; the factory takes no argument."""
    import importlib

    module, _, name = reference.partition(":")
    if not name:
        raise ContractError(f"{reference!r} is not module:factory")
    made = getattr(importlib.import_module(module), name)()
    if not callable(made):
        raise ContractError(f"{reference!r} made {type(made).__name__}, not a callable")
    return made


def _valid(scores: object, n: int) -> np.ndarray:
    out = np.asarray(scores, dtype=float)
    if out.ndim == 2 and out.shape[1] == 1:
        out = out[:, 0]
    if out.shape != (n,):
        raise ValueError(f"scorer returned shape {out.shape}, expected ({n},)")
    if not np.isfinite(out).all():
        raise ValueError("scorer returned a score that is not finite")
    if ((out < 0) | (out > 1)).any():
        raise ValueError("scorer returned a score outside [0, 1]")
    return out


def scored_batches(scorer: Scorer) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Batches of clips with clip_score and failure, one for one: many small ones would cost more to
    hand back than to score."""

    def attempt(
        rows: pd.DataFrame, video: np.ndarray, at: int, score: np.ndarray, failure: np.ndarray, fails: bool = False
    ) -> bool:
        """Score rows sorted by video number, into the places from `at`; whether all went at once.

        With `fails`, rows of several videos are known to hold one at fault, and are not tried whole.
        """
        single = video[0] == video[-1]
        if single or not fails:
            try:
                score[at : at + len(rows)] = _valid(scorer(rows), len(rows))
                return True
            except Exception as e:  # noqa: BLE001
                if single:
                    failure[at : at + len(rows)] = f"{type(e).__name__}: {e}"
                    return False
        middle = (video[0] + video[-1] + 1) // 2
        cut = int(np.searchsorted(video, middle))
        first = attempt(rows.iloc[:cut], video[:cut], at, score, failure)
        attempt(rows.iloc[cut:], video[cut:], at + cut, score, failure, fails=first)
        return False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            number = batch.groupby(list(ROW_KEY), dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(number, kind="stable")
            rows = batch.iloc[order]
            score, failure = np.full(len(rows), np.nan), np.full(len(rows), None, object)
            attempt(rows, number[order], 0, score, failure)
            yield rows.assign(clip_score=score, failure=failure)

    return run


def score_clips(clips: DataFrame, scorer: Scorer) -> DataFrame:
    """Clip rows with `clip_score`, or with `failure` where the scorer failed.

    Clip rows are spread evenly first, since the scorer costs far more than moving their few
    columns: runs of `VIDEO_RUN` clips stay together, so a video is scored in one task unless it
    is very long. A batch that fails is halved by video until the videos at fault stand alone;
    every other video is scored. Where the first half goes, the fault is in the second, which is halved
    untried.
    """
    columns = clips.columns
    run_of = F.floor(F.col("clip_index") / VIDEO_RUN)
    clips = clips.repartition(*[F.col(c) for c in ROW_KEY], run_of)

    shown = ", ".join(f"`{c}` {t}" for c, t in clips.dtypes)
    out = clips.mapInPandas(scored_batches(scorer), f"{shown}, clip_score double, failure string")
    score = F.when(F.col("failure").isNull(), F.col("clip_score"))
    return out.select(*columns, score.alias("clip_score"), "failure")


def video_rows(
    scored: DataFrame,
    split_videos: DataFrame,
    mapping: DataFrame,
    *,
    mode: str = "mean-prob",
    frames_per_clip: int = 1,
) -> DataFrame:
    """A score table of the whole split: ok, error and missing videos, none dropped.

    A video with any failed clip is an error, a split video without clips is missing; videos whose
    label is excluded are no part of the table. The scorer runs once: everything about a video
    comes from one aggregate, which the split is joined to. The median needs two passes, so its
    clip scores are checkpointed first.
    """
    if mode == "median":
        scored = cut_lineage(scored)
    clips = scored.withColumnRenamed("clip_score", "score")
    reduced = clip_to_video(clips, ROW_KEY, mode, more={"_failure": F.max("failure")})
    known = split_videos.select(*ROW_KEY, "label_key", "method").join(mapping, "label_key")
    videos = join_null_safe(
        known.where(F.col("mapped") != "exclude"), reduced, ROW_KEY, "left"
    )
    status = (
        F.when(F.col("n_clips").isNull(), "missing")
        .when(F.col("_failure").isNotNull(), "error")
        .otherwise("ok")
    )
    ok = status == "ok"
    return videos.select(
        *ROW_KEY,
        F.col("mapped").try_cast("int").alias("label"),
        F.when(ok, F.col("score")).alias("score"),
        status.alias("status"),
        "label_key",
        "method",
        F.when(ok, F.col("n_clips")).alias("n_clips"),
        F.when(ok, F.col("n_clips") * frames_per_clip).alias("n_frames"),
    )


def frame_records(scored: DataFrame, frames: str = "frame_indices") -> DataFrame:
    """One row per frame of every scored clip, the clip's score repeated."""
    from scoreloom.sources.tables import frame_rows

    ok = scored.where(F.col("failure").isNull())
    rows = frame_rows(ok, [*ROW_KEY, "clip_index"], frames)
    return rows.select(
        *ROW_KEY, "clip_index", "frame_index", F.col("clip_score").alias("frame_score"), "clip_score"
    )


def request_key(columns: Sequence[str]) -> Column:
    """The fingerprint of a scoring request: a hash of everything its result depends on."""
    text = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.sha2(text, 256)


def to_score(requests: DataFrame, finished: DataFrame) -> DataFrame:
    """Requests without an identical finished result; one with errors is run again."""
    reusable = finished.where(F.col("error") == 0).select("request").distinct()
    return requests.join(reusable, "request", "left_anti")
