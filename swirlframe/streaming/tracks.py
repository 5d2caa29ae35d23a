"""Tracks of a stream of particles: the state of an open track is its last two points, so it doesn't grow with its length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..kernels import particles
from ..params import PTVParameters

_POINT = [f"{n}{k}" for k in (0, 1) for n in ("frame", *particles.FIELDS)]
#: State by track: points so far, frames missed, the last two points, and those that wait until the track is long enough.
HEAD = "n long, missed long, " + ", ".join(f"{c} {'long' if c.startswith('frame') else 'double'}" for c in _POINT) + ", waiting array<struct<frame:long,x:double,y:double>>"


class _Open(list):
    """The last points of a track, as the tracker sees it, with what else is known of it."""

    def __init__(self, points: list, number: int, n: int, waiting: list) -> None:
        super().__init__(points)
        self.number, self.n, self.waiting = number, n, waiting


class TrackState(StatefulProcessor):
    """Links whole frames in order; a point comes out as soon as its track has ``least`` of them."""

    def __init__(self, params: PTVParameters, max_gap: int, least: int, idle_ms: int | None) -> None:
        self.p, self.max_gap, self.least, self.idle_ms = params, max_gap, least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getMapState("heads", "track long", HEAD)
        self.clock = handle.getValueState("clock", "frame long, born long")

    def _load(self) -> list[_Open]:
        out = []
        for (number,), v in sorted(self.heads.iterator(), key=lambda kv: kv[0][0]):
            n, missed, rest, waiting = v[0], v[1], v[2:12], v[12]
            points = [(int(rest[5 * k]), *map(float, rest[5 * k + 1 : 5 * k + 5])) for k in (0, 1) if rest[5 * k] is not None]
            t = _Open(points, number, n, [tuple(q) for q in waiting])
            t.missed = missed
            out.append(t)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["frame_idx", "particle_id"])  # one batch of the stream
        last, born = self.clock.get() if self.clock.exists() else (None, 0)
        before = self._load()
        tracker = particles.Tracker(self.p, self.max_gap)
        tracker.live, tracker.missed = list(before), [t.missed for t in before]
        none = {n: np.zeros(0) for n in particles.FIELDS}
        out: list[tuple] = []
        for frame, own in found.groupby("frame_idx"):
            frame = int(frame)
            if last is not None:
                for k in range(last + 1, min(frame, last + self.max_gap + 2)):  # by then every open track has ended
                    tracker.add(k, none)
            tracker.add(frame, {n: own[n].to_numpy(float) for n in particles.FIELDS})
            last = frame
            for i, t in enumerate(tracker.live):
                if not isinstance(t, _Open):
                    born += 1
                    t = tracker.live[i] = _Open(t, born, 0, [])
                if t[-1][0] == frame:
                    t.n += 1
                    t.waiting.append(t[-1][:3])
                    del t[:-2]
                if t.n >= self.least:
                    out += [(key[0], t.number, *q) for q in t.waiting]
                    t.waiting = []
            tracker.done = []
        open_ = {t.number for t in tracker.live}
        for t in before:
            if t.number not in open_:
                self.heads.removeKey((t.number,))
        for t, missed in zip(tracker.live, tracker.missed, strict=True):
            points = [*t, *[(None,) * 5] * (2 - len(t))]
            self.heads.updateValue((t.number,), (t.n, missed, *points[0], *points[1], t.waiting))
        self.clock.update((last, born))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["recording", "track_id", "frame", "x", "y"]).astype({"track_id": "int64", "frame": "int64", "x": float, "y": float})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A recording that has gone quiet: its open tracks end. Their points are out already."""
        self.heads.clear()
        self.clock.clear()
        yield pd.DataFrame({"recording": pd.Series([], dtype=str), "track_id": pd.Series([], dtype="int64"), "frame": pd.Series([], dtype="int64"), "x": pd.Series([], dtype=float), "y": pd.Series([], dtype=float)})

    def close(self) -> None:
        pass


def live_tracks(found: DataFrame, params: PTVParameters | None = None, max_gap: int = 0, min_track_length: int = 3, recording: str = "recording", idle_ms: int | None = None) -> DataFrame:
    """recording, track_id, frame, x, y: points of the tracks of a stream of particles, as they come.

    A batch brings whole frames in order. A track of ``min_track_length`` points gives those that it has, and from then on each at once; it
    ends after ``max_gap`` frames without one, or when its recording has been quiet for ``idle_ms``. State, a row for each open track, is
    held by RocksDB, which this sets for the session. Tracks are numbered by birth, so numbers of short ones are missing.
    """
    found.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    state = TrackState(params or PTVParameters(), max_gap, min_track_length, idle_ms)
    return found.groupBy(recording).transformWithStateInPandas(state, "recording string, track_id long, frame long, x double, y double", "Append", "None" if idle_ms is None else "ProcessingTime")
