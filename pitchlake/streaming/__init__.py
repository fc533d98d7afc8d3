"""Detections as a stream: the conservative tracker with state, and windowed counts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tracking import Conservative, advance


def track_stream(dets: DataFrame, dt: float, p: Conservative | None = None, key: str = "match_id") -> DataFrame:
    """The conservative tracker over a stream of detections (``match_id, frame, t, det_idx, mx, my``).

    The state of a match is its open tracks, bounded by the people on a pitch.
    A batch's frames are taken in order; frames must not arrive after later ones
    were tracked (those rows get tracklet -1). Short tracklets are left for the
    reader to drop, since a stream cannot know that one stays short.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    p = p or Conservative()
    schema = f"{key} {dets.schema[key].dataType.simpleString()}, tracklet_id int, frame int, t double, x_m double, y_m double, det_idx int"

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks, number, last = pickle.loads(state.get[0]) if state.exists else ([], 1, -1)
        rows = pd.concat(list(batches)).sort_values(["frame", "det_idx"])
        for (frame, t), g in rows.groupby(["frame", "t"], sort=True):
            if frame > last:
                tracks, number, mine = advance(tracks, number, t, g[["mx", "my"]].to_numpy(), p, dt)
                last = frame
            else:
                mine = [-1] * len(g)
            yield pd.DataFrame({key: group[0], "tracklet_id": mine, "frame": frame, "t": t, "x_m": g["mx"].to_numpy(), "y_m": g["my"].to_numpy(), "det_idx": g["det_idx"].to_numpy()})
        state.update((pickle.dumps((tracks, number, int(last))),))

    return dets.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


def counts_by_window(rows: DataFrame, time: str = "at", size: str = "30 seconds", slide: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Rows in sliding windows of event time, late rows allowed for a while."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
