"""Segments of a growing trajectory as keyed state: a video's open segment, and nothing before it.

The state of a video is the rows of its open segment, which are only appended
until a gap closes it, and the few visible rows that decide about the next gaps.
A batch therefore costs what it brings, and a segment is read once, when it closes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.gaps import diagonal
from ..params import DEFAULTS, RallyParameters

#: A row of a closed segment.
CLOSED = "video_id long, segment_id long, pos long, frame long, visible boolean, x double, y double"
OPEN = "pos long, frame long, visible boolean, x double, y double"
SCAN = "pos array<long>, frame array<long>, x array<double>, y array<double>, rows long, last_frame long, segment long, settled long, late long"
#: Visible rows before a gap that its speeds are taken from.
BEHIND = 3


def names(ddl: str) -> list[str]:
    """Column names of a schema text."""
    return [f.split()[0] for f in ddl.split(", ")]


def limits(videos: DataFrame, p: RallyParameters = DEFAULTS) -> DataFrame:
    """What the gaps of each video are judged by, in rows and pixels."""
    fps = F.col("fps")
    return videos.where("fps > 0").select(
        "video_id", p.restart_gap(fps).alias("restart"), p.split_gap(fps).alias("split"), p.long_gap(fps).alias("long"), (F.lit(0.30) * fps).cast("int").alias("behind"),
        (F.lit(0.45) * fps).cast("int").alias("ahead"), diagonal().alias("diag"), (F.lit(p.top_edge_fraction) * F.col("height")).alias("top"),
    )


def decide(pos: np.ndarray, frame: np.ndarray, x: np.ndarray, y: np.ndarray, limit: dict, rows: int, settled: int) -> tuple[list[int], int]:
    """Places of visible rows that a split follows, and the place of the last visible row whose gap is judged.

    The arrays hold visible rows in order; ``rows`` is how many rows the video has,
    ``settled`` the place up to which gaps were judged before. A gap is judged
    once all rows that it looks ahead at are there.
    """
    speed = np.r_[np.nan, np.hypot(np.diff(x), np.diff(y)) / np.maximum(1.0, np.diff(frame))] if len(pos) else np.zeros(0)
    size = np.diff(pos) - 1
    splits = []
    for i in np.flatnonzero((size >= limit["restart"]) & (pos[:-1] > settled)):
        clear = bool(y[i] >= limit["top"] and y[i + 1] >= limit["top"])
        cut = size[i] >= limit["long"] or (size[i] >= limit["split"] and clear)
        if not cut and clear:
            if rows - 1 < pos[i + 1] + limit["ahead"]:
                return splits, int(pos[i]) - 1
            lately = [speed[i - k] for k in range(BEHIND) if i - k >= 1 and pos[i - k - 1] >= pos[i] - limit["behind"] and np.isfinite(speed[i - k])]
            after = speed[i + 2 :][pos[i + 2 :] <= pos[i + 1] + limit["ahead"]]
            after = after[np.isfinite(after)]
            jump = np.hypot(x[i + 1] - x[i], y[i + 1] - y[i])
            cut = len(lately) >= 2 and len(after) >= 2 and np.median(lately) <= 0.004 * limit["diag"] and after.max() >= 0.01 * limit["diag"] and jump >= 0.03 * limit["diag"]
        if cut:
            splits.append(int(pos[i]))
    # the last visible row's gap has no end yet
    return splits, int(pos[-1]) - 1 if len(pos) else settled


class Segments(StatefulProcessor):
    """Takes a video's new frames, returns the rows of segments that they close."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", OPEN)
        self.scan = handle.getValueState("scan", SCAN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = list(rows)
        new = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        limit = {c: new[c].iloc[0] for c in ("restart", "split", "long", "behind", "ahead", "diag", "top")}
        pos, frame, x, y, count, last, segment, settled, late = self.scan.get() or ([], [], [], [], 0, None, 0, -1, 0)
        columns = [new[c].to_numpy(kind) for c, kind in (("frame", np.int64), ("visible", bool), ("x", float), ("y", float))]
        order = np.lexsort(columns[::-1])  # numbers that are not there come last
        order = order[np.r_[np.diff(columns[0][order]) > 0, True]]
        if last is not None:
            order = order[columns[0][order] > last]
        late += len(new) - len(order)
        frames, seen, xs, ys = (c[order] for c in columns)
        places = np.arange(count, count + len(order))
        count += len(order)
        tail = [np.r_[np.asarray(a, kind), b[seen]] for a, b, kind in zip((pos, frame, x, y), (places, frames, xs, ys), (np.int64, np.int64, float, float), strict=True)]
        splits, settled = decide(*tail, limit, count, settled)
        added = list(zip(places.tolist(), frames.tolist(), seen.tolist(), *([None if v != v else v for v in c.tolist()] for c in (xs, ys)), strict=True))
        if splits:
            whole = [*(tuple(r) for r in self.open.get()), *added]
            left, closed = 0, []
            for cut in splits:
                end = bisect_right(whole, cut, key=lambda r: r[0])
                first = next((k for k in range(left, end) if whole[k][2]), left)  # what closes a segment is a visible row
                closed += [(key[0], segment, *r) for r in whole[first:end]]
                segment, left = segment + 1, end
            # one frame for all that a batch closes of a video
            yield pd.DataFrame(closed, columns=names(CLOSED))
            self.open.put(whole[left:]) if whole[left:] else self.open.clear()
        elif added:
            self.open.appendList(added)
        # rows before the first gap that is not judged, as many as its speeds need
        keep = max(0, int(np.searchsorted(tail[0], settled, "right")) - BEHIND)
        if len(order):
            last = int(frames[-1])
        self.scan.update((*(a[keep:].tolist() for a in tail), count, last, segment, settled, late))

    def close(self) -> None:
        pass


def closed_segments(frames: DataFrame, videos: DataFrame, p: RallyParameters = DEFAULTS) -> DataFrame:
    """Rows of the segments of a streaming DataFrame of frames, each once its segment is closed.

    Frames of a video come in order; one that is not behind all that came in
    earlier batches is late and left out (the state counts them). Of rows of one
    frame in a batch the last in order of (visible, x, y) counts. Null frames or
    ids, and videos without a positive rate, are left out; null visible: invisible.
    """
    rows = frames.where("video_id is not null and frame is not null").select("video_id", "frame", F.coalesce("visible", F.lit(False)).alias("visible"), "x", "y")
    return rows.join(limits(videos, p), "video_id").groupBy("video_id").transformWithStateInPandas(Segments(), CLOSED, "Append", "None")
