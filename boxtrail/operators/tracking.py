"""Multi-object tracking: Kalman-filtered boxes, one tracker for each stream, in batches of frames.

A stream's frames follow one another, so a stream is one sequence; streams run side by side. Rows arrive sorted by
stream, frame and detection, a batch at a time, and only a tracker's state is held between batches, so memory doesn't grow
with a stream's length. Frame ids that are missing are steps without detections, as long as any track lives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxtrail.operators.assign import solve


@dataclass(frozen=True)
class TrackerConfig:
    """Defaults are fixed values."""

    kind: str = "sort"  # sort, kalman or two_pass
    max_age: int = 10
    min_hits: int = 1
    iou_threshold: float = 0.3
    init_score: float = 0.3
    high: float = 0.5
    low: float = 0.1
    measurement_noise: tuple[float, ...] = (1.0, 1.0, 10.0, 10.0)
    process_noise: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0, 0.01, 0.01, 0.0001)
    return_all: bool = False
    assignment: str = "auto"
    drop_zero_edges: bool = False
    spatial_threshold: int = 100
    cell: float = 100.0


# --- filter -------------------------------------------------------------------------------------


def to_z(b: np.ndarray) -> np.ndarray:
    """Center, area and aspect of corner boxes, a row each."""
    w, h = b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
    return np.stack([(b[:, 0] + b[:, 2]) / 2, (b[:, 1] + b[:, 3]) / 2, w * h, np.divide(w, h, out=np.ones_like(w), where=h != 0)], 1)


def from_z(z: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        h = np.sqrt(z[:, 2] / z[:, 3])
        w = z[:, 3] * h
    return np.stack([z[:, 0] - w / 2, z[:, 1] - h / 2, z[:, 0] + w / 2, z[:, 1] + h / 2], 1)


class KalmanFilter:
    """Linear filter with constant matrices over many states at once: x is (n, d), p is (n, d, d)."""

    def __init__(self, f: np.ndarray, h: np.ndarray, q: np.ndarray, r: np.ndarray):
        self.f, self.h, self.q, self.r = f, h, q, r

    def predict(self, x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.f.T, self.f @ p @ self.f.T + self.q

    def update(self, x: np.ndarray, p: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New states and covariances, and which updates were possible (an innovation that can't be inverted isn't)."""
        s = self.h @ p @ self.h.T + self.r
        ok = np.abs(np.linalg.det(s)) > 0
        inverse = np.zeros_like(s)
        if ok.any():
            inverse[ok] = np.linalg.inv(s[ok])
        k = p @ self.h.T @ inverse
        y = z - x @ self.h.T
        return x + (k @ y[..., None])[..., 0], (np.eye(x.shape[1]) - k @ self.h) @ p, ok


def box_filter(c: TrackerConfig) -> KalmanFilter:
    """Center, area, aspect and the velocities of the first three."""
    f = np.eye(7)
    f[[0, 1, 2], [4, 5, 6]] = 1
    return KalmanFilter(f, np.eye(4, 7), np.diag(c.process_noise), np.diag(c.measurement_noise))


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of corner boxes, a matrix."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = np.clip(w, 0, None) * np.clip(h, 0, None)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=(inter > 0) & (union > 0))


def cell_overlaps(a: np.ndarray, b: np.ndarray, size: float) -> np.ndarray:
    """overlaps() with a product only of boxes whose cells meet; the same matrix."""
    out = np.zeros((len(a), len(b)))
    if not len(a) or not len(b):
        return out
    low_a, high_a, low_b, high_b = (np.floor(a[:, :2] / size), np.ceil(a[:, 2:] / size), np.floor(b[:, :2] / size), np.ceil(b[:, 2:] / size))
    near = ((low_a[:, None] <= high_b[None]) & (low_b[None] <= high_a[:, None])).all(2)
    i, j = np.nonzero(near)
    for k in range(0, len(i), 65_536):
        x, y = a[i[k : k + 65_536]], b[j[k : k + 65_536]]
        w, h = np.minimum(x[:, 2], y[:, 2]) - np.maximum(x[:, 0], y[:, 0]), np.minimum(x[:, 3], y[:, 3]) - np.maximum(x[:, 1], y[:, 1])
        inter = np.clip(w, 0, None) * np.clip(h, 0, None)
        union = (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1]) + (y[:, 2] - y[:, 0]) * (y[:, 3] - y[:, 1]) - inter
        out[i[k : k + 65_536], j[k : k + 65_536]] = np.divide(inter, union, out=np.zeros_like(inter), where=(inter > 0) & (union > 0))
    return out


# --- trackers -----------------------------------------------------------------------------------

_COUNTERS = ("id", "age", "hits", "hit_streak", "since", "det")


class Tracker:
    """One stream's tracks, ordered by id. step() takes a frame's corner boxes and scores, an array of rows of five, and
    gives the rows to report: boxes, ids, and places of the detections that were used in this frame (-1: none)."""

    def __init__(self, config: TrackerConfig = TrackerConfig()):
        self.config, self.filter = config, box_filter(config)
        self.next_id = 1
        self.steps = 0
        self._clear()

    def _clear(self) -> None:
        self.x, self.p = np.zeros((0, 7)), np.zeros((0, 7, 7))
        self.n = {c: np.zeros(0, np.int64) for c in _COUNTERS}

    def clear(self) -> None:
        """Drops all tracks; all kinds but kalman start over with ids and steps."""
        self._clear()
        if self.config.kind != "kalman":
            self.next_id, self.steps = 1, 0

    def remove(self, track_id: int) -> None:
        self._keep(self.n["id"] != track_id)

    def __len__(self) -> int:
        return len(self.x)

    def state(self) -> dict:
        return {"x": self.x.tolist(), "p": self.p.reshape(-1, 49).tolist(), "n": {c: v.tolist() for c, v in self.n.items()}, "next_id": self.next_id, "steps": self.steps}

    @classmethod
    def restore(cls, config: TrackerConfig, state: dict) -> Tracker:
        t = cls(config)
        t.x, t.p = np.array(state["x"], float).reshape(-1, 7), np.array(state["p"], float).reshape(-1, 7, 7)
        t.n = {c: np.array(v, np.int64) for c, v in state["n"].items()}
        t.next_id, t.steps = state["next_id"], state["steps"]
        return t

    def _keep(self, on: np.ndarray) -> None:
        self.x, self.p, self.n = self.x[on], self.p[on], {c: v[on] for c, v in self.n.items()}

    def boxes(self) -> np.ndarray:
        return from_z(self.x[:, :4])

    def _predict(self) -> None:
        shrinking = self.x[:, 6] + self.x[:, 2] <= 0
        self.x[shrinking, 6] = 0
        self.x, self.p = self.filter.predict(self.x, self.p)
        n = self.n
        n["age"] += 1
        n["hit_streak"][n["since"] > 0] = 0
        n["since"] += 1
        n["det"][:] = -1
        b = self.boxes()
        good = np.isfinite(b).all(1) & (b[:, 0] < b[:, 2]) & (b[:, 1] < b[:, 3])
        if self.config.drop_zero_edges:
            good &= (np.abs(b) >= np.finfo(np.float32).tiny).all(1)
        self._keep(good)

    def _match(self, dets: np.ndarray, at: np.ndarray, tracks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Updates tracks (places) with detections (places at); the places of both that stay without a partner."""
        c = self.config
        boxes = self.boxes()[tracks]
        iou = cell_overlaps(dets[at, :4], boxes, c.cell) if len(tracks) >= c.spatial_threshold else overlaps(dets[at, :4], boxes)
        pairs = solve(1 - iou, 1 - c.iou_threshold, c.assignment)
        above = [(i, j) for i, j in pairs if iou[i, j] > c.iou_threshold]
        if above:
            i, j = at[[a for a, _ in above]], tracks[[b for _, b in above]]
            x, p, ok = self.filter.update(self.x[j], self.p[j], to_z(dets[i, :4]))
            self.x[j[ok]], self.p[j[ok]] = x[ok], p[ok]
            seen = j[ok]
            self.n["hits"][seen] += 1
            self.n["hit_streak"][seen] += 1
            self.n["since"][seen] = 0
            self.n["det"][seen] = i[ok]
            self.n["since"][j[~ok]] = c.max_age + 1  # an update that fails ends the track
        used = pairs if c.kind == "kalman" else above  # the kalman kind also drops pairs below the threshold
        free = np.ones(len(at), bool)
        free[[a for a, _ in used]] = False
        left = np.ones(len(tracks), bool)
        left[[b for _, b in above]] = False
        return at[free], tracks[left]

    def _create(self, dets: np.ndarray, at: np.ndarray) -> None:
        at = at[dets[at, 4] >= self.config.init_score]
        if not len(at):
            return
        k = len(at)
        x = np.zeros((k, 7))
        x[:, :4] = to_z(dets[at, :4])
        self.x, self.p = np.concatenate((self.x, x)), np.concatenate((self.p, np.repeat(np.diag([10.0] * 4 + [1e4] * 3)[None], k, 0)))
        new = {"id": np.arange(self.next_id, self.next_id + k), "age": np.zeros(k), "hits": np.zeros(k), "hit_streak": np.zeros(k), "since": np.zeros(k), "det": at}
        self.n = {c: np.concatenate((v, new[c])).astype(np.int64) for c, v in self.n.items()}
        self.next_id += k

    def step(self, dets: np.ndarray) -> dict[str, np.ndarray]:
        c = self.config
        dets = np.asarray(dets, float).reshape(-1, 5)
        self._predict()
        every = np.arange(len(self))
        finite = np.flatnonzero(np.isfinite(dets).all(1))
        if c.kind == "two_pass":
            score = dets[finite, 4]
            high, low = finite[score >= c.high], finite[(score >= c.low) & (score < c.high)]
            rest, left = self._match(dets, high, every)
            self._match(dets, low, left)
        else:
            rest, _ = self._match(dets, finite, every)
        self._keep(self.n["since"] <= c.max_age)
        self._create(dets, rest)
        self.steps += 1
        on = np.ones(len(self), bool) if c.return_all else (self.n["since"] < 1) & ((self.n["hit_streak"] >= c.min_hits) | (self.steps <= c.min_hits))
        return {"box": self.boxes()[on]} | {k: v[on] for k, v in self.n.items()}


TRACKS = "stream_id long, frame_id long, track_id long, x double, y double, w double, h double, det_id long, class_id long, confidence double, age long, hits long, hit_streak long, steps_since_update long, is_extrapolated boolean"


Rows = dict[str, np.ndarray]

#: What a frame's detections hold.
FIELDS = ("det_id", "class_id", "x", "y", "w", "h", "confidence")

_NO_ROWS: Rows = {c: np.zeros(0) for c in FIELDS}


def as_rows(batch: pd.DataFrame) -> Rows:
    """Arrays of a batch; an unknown class is -1."""
    return {c: batch[c].fillna(-1).to_numpy(np.int64) if c in ("det_id", "class_id") else batch[c].to_numpy(float) for c in FIELDS}


def run_frame(tracker: Tracker, memory: dict[int, tuple[int, float]], stream: int, frame: int, rows: Rows) -> Rows:
    """A step with the detections of a frame, as arrays by column of TRACKS. memory: the last class and confidence of each
    track, forgotten with it."""
    x, y, w, h = (rows[c] for c in "xywh")
    got = tracker.step(np.stack([x, y, x + w, y + h, rows["confidence"]], 1))
    alive, det = tracker.n["id"].tolist(), tracker.n["det"].tolist()
    for track, d in zip(alive, det, strict=True):
        if d >= 0:
            memory[track] = (int(rows["class_id"][d]), float(rows["confidence"][d]))
    if len(memory) > len(alive):
        for track in set(memory).difference(alive):
            del memory[track]
    b, n, used = got["box"], len(got["id"]), got["det"]
    known = [memory.get(t, (-1, np.nan)) for t in got["id"].tolist()]
    ids = np.full(n, -1, np.int64)
    ids[used >= 0] = rows["det_id"][used[used >= 0]]
    return {
        "stream_id": np.full(n, stream), "frame_id": np.full(n, frame), "track_id": got["id"], "x": b[:, 0], "y": b[:, 1], "w": b[:, 2] - b[:, 0], "h": b[:, 3] - b[:, 1], "det_id": ids, "seen": used >= 0,
        "class_id": np.array([k[0] for k in known], np.int64), "confidence": np.array([k[1] for k in known], float), "age": got["age"], "hits": got["hits"], "hit_streak": got["hit_streak"], "steps_since_update": got["since"],
    }


def as_frame(done: list[Rows]) -> pd.DataFrame:
    """The arrays of several frames as one batch of TRACKS."""
    c = {k: np.concatenate([d[k] for d in done]) for k in done[0]}
    c["det_id"] = pd.arrays.IntegerArray(c["det_id"], ~c.pop("seen"))
    c["class_id"] = pd.arrays.IntegerArray(c["class_id"], c["class_id"] < 0)
    return pd.DataFrame(c | {"is_extrapolated": c["steps_since_update"] > 0})[[x.split()[0] for x in TRACKS.split(", ")]]


class StreamRunner:
    """Frames of one stream in order, whatever batches they come in; a frame is run once the next one begins."""

    def __init__(self, config: TrackerConfig, stream: int):
        self.config, self.stream = config, stream
        self.tracker, self.memory, self.last, self.open = Tracker(config), {}, None, None

    def _run(self, frame: int, rows: Rows) -> list[Rows]:
        out = []
        gap = self.last + 1 if self.last is not None else frame
        while gap < frame and len(self.tracker):
            out.append(run_frame(self.tracker, self.memory, self.stream, gap, _NO_ROWS))
            gap += 1
        self.tracker.steps += frame - gap if gap < frame else 0  # steps with neither tracks nor detections
        out.append(run_frame(self.tracker, self.memory, self.stream, frame, rows))
        self.last = frame
        return out

    def feed(self, frames: np.ndarray, rows: Rows) -> list[Rows]:
        """frames: the frame of each row, rising."""
        out = []
        cut = np.flatnonzero(np.diff(frames)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(frames)], strict=True):
            frame, part = int(frames[a]), {c: v[a:b] for c, v in rows.items()}
            if self.open is not None and self.open[0] == frame:
                self.open = (frame, {c: np.concatenate((self.open[1][c], part[c])) for c in FIELDS})
                continue
            out += self.finish()
            self.open = (frame, part)
        return out

    def finish(self) -> list[Rows]:
        if self.open is None:
            return []
        (frame, rows), self.open = self.open, None
        return self._run(frame, rows)


def track(detections: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """Tracks (schema TRACKS) of detections (stream_id, frame_id, det_id, class_id, confidence, x, y, w, h)."""
    columns = ["stream_id", "frame_id", *FIELDS]
    have = detections if "class_id" in detections.columns else detections.withColumn("class_id", F.lit(None).cast("long"))
    ordered = have.select(*columns).where("stream_id is not null and frame_id is not null").repartition("stream_id").sortWithinPartitions("stream_id", "frame_id", "det_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner: StreamRunner | None = None
        for batch in batches:
            streams, frames, rows = batch.stream_id.to_numpy(np.int64), batch.frame_id.to_numpy(np.int64), as_rows(batch)
            cut, done = np.flatnonzero(np.diff(streams)) + 1, []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(streams)], strict=True):
                if a == b:
                    continue
                if runner is None or runner.stream != streams[a]:
                    done += runner.finish() if runner else []
                    runner = StreamRunner(config, int(streams[a]))
                done += runner.feed(frames[a:b], {c: v[a:b] for c, v in rows.items()})
            if done:
                yield as_frame(done)
        if runner and (done := runner.finish()):
            yield as_frame(done)

    return ordered.mapInPandas(run, TRACKS)


def command_line(config: TrackerConfig = TrackerConfig()) -> TrackerConfig:
    """The settings of the video command (fixed values)."""
    return replace(config, max_age=25, min_hits=3, iou_threshold=0.3, init_score=0.25)
