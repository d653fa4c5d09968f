"""Shapes on grids: outlines and their areas, morphology, hulls, polygons, and the court in a median image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Steps (dy, dx) to the eight neighbours, clockwise from the right.
STEPS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
#: Fixed values of the court estimate, which its results are compared under.
CLUSTERS, CLOSING, OPENING, TOP, MARGIN, STRAIGHT, OVERLAP = 7, 11, 5, 0.28, 0.08, 0.018, 3
#: Rows and columns, in shares, of the boxes where the floor is looked for, and where its component counts more.
FLOOR_BOX, CENTRE_BOX = (0.55, 0.90, 0.25, 0.75), (0.45, 1.0, 0.2, 0.8)


def labels(mask: np.ndarray) -> np.ndarray:
    """Components (eight neighbours) numbered from 1 in order of their first cell; 0 elsewhere."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        low = np.pad(np.where(mask, label, big), 1, constant_values=big)
        # along rows and columns at a time: the least of three, twice
        low = np.minimum(np.minimum(low[:-2], low[1:-1]), low[2:])
        low = np.where(mask, np.minimum(np.minimum(low[:, :-2], low[:, 1:-1]), low[:, 2:]), 0)
        # a cell's label is a cell of its component, whose label may be lower already
        low = np.where(mask, np.minimum(low, np.r_[0, low.ravel()][low]), 0)
        if (low == label).all():
            return np.searchsorted(np.unique(label[mask]), label) * mask + mask if mask.any() else label
        label = low


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with all that its outlines enclose: cells from which no step up, down or aside leads out."""
    open_ = ~np.pad(mask, 1)
    outside = np.zeros_like(open_)
    outside[0] = outside[-1] = outside[:, 0] = outside[:, -1] = True
    while True:
        wide = outside.copy()
        wide[1:] |= outside[:-1]
        wide[:-1] |= outside[1:]
        wide[:, 1:] |= outside[:, :-1]
        wide[:, :-1] |= outside[:, 1:]
        wide &= open_
        if (wide == outside).all():
            return ~outside[1:-1, 1:-1]
        outside = wide


def outline(mask: np.ndarray) -> np.ndarray:
    """Cells (y, x) of the outer border of the component with the mask's first cell, in clockwise order.

    Follows the border with the outside to the left until it would leave its
    start in the same direction again; thin parts are passed on both sides.
    """
    wide = np.pad(mask, 1)
    y, x = (int(v) for v in np.unravel_index(np.argmax(wide), wide.shape))
    start, look, first, points = (y, x), 4, None, []
    while True:
        turn = next((k % 8 for k in range(look, look + 8) if wide[y + STEPS[k % 8][0], x + STEPS[k % 8][1]]), None)
        if turn is None:
            return np.array([(y - 1, x - 1)])
        if (y, x) == start and turn == first:
            return np.array(points)
        first = turn if first is None else first
        points.append((y - 1, x - 1))
        y, x = y + STEPS[turn][0], x + STEPS[turn][1]
        # the neighbour that was looked at last is outside; the next look begins there
        look = (turn + 6 - turn % 2) % 8


def polygon_area(points: np.ndarray) -> float:
    """Area inside a closed line of (y, x) points."""
    y, x = points.T.astype(float)
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def decode_by_area(cells: Column, width: int, height: int, threshold: float, out_width: float, out_height: float) -> Column:
    """Point of a row-major grid: centre of the box of the outer outline that encloses the largest area.

    Only outermost outlines count, holes and what lies in them with them. Areas
    run through centres of cells, so a line has none; of equal areas the outline
    whose first cell comes first. No cell over the threshold, null or a grid of
    another size: (0, 0), not visible.
    """

    @F.pandas_udf("area double, x double, y double, visible boolean")
    def decode(grids: pd.Series) -> pd.DataFrame:
        rows = []
        for g in grids:
            best = (0.0, 0.0, 0.0, False)
            if g is not None and len(g) == width * height:
                label = labels(filled(np.asarray(g, float).reshape(height, width) > threshold))
                for k in range(1, label.max() + 1):
                    border = outline(label == k)
                    area = polygon_area(border)
                    if not best[3] or area > best[0]:
                        (y0, x0), (y1, x1) = border.min(0), border.max(0)
                        best = (area, (x0 + x1 + 1) / 2 * out_width / width, (y0 + y1 + 1) / 2 * out_height / height, True)
            rows.append(best)
        return pd.DataFrame(rows, columns=["area", "x", "y", "visible"])

    return decode(cells)


# ---------------------------------------------------------------- resize formulations


def taps(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of m places the two of n that it lies between, on half-pixel centres, and its share of the second."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.minimum(np.floor(at).astype(int), max(n - 2, 0))
    return low, np.minimum(low + 1, n - 1), at - low


def formulations(bits: tuple[int, ...] = (8, 10, 11, 12, 14, 15, 16)) -> list[tuple[int, int, str, int, str]]:
    """The parameter table: passes, bits of a weight (0: floats), the weight that is rounded, what is added before the shift, and how floats are rounded."""
    whole = [(passes, b, first, add, "") for passes in (1, 2) for b in bits for first in ("near", "far") for add in (0, 1 << (b - 1))]
    return [(passes, 0, "", 0, how) for passes in (1, 2) for how in ("even", "up", "down")] + whole


def resize_by(images: np.ndarray, width: int, height: int, passes: int, bits: int, first: str, add: int, how: str) -> np.ndarray:
    """Bilinear resize of images (image, row, column) of bytes under one formulation.

    Rows of two weights are applied to columns, then to rows; two passes round in
    between, one pass at the end only. ``first`` says which of two whole weights
    is rounded, the other one being what is left.
    """
    turn = {"even": np.rint, "up": lambda v: np.floor(v + 0.5), "down": np.trunc}.get(how)

    def weights(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not bits:
            return 1 - share, share
        far = np.rint(share * (1 << bits)).astype(np.int64) if first == "far" else (1 << bits) - np.rint((1 - share) * (1 << bits)).astype(np.int64)
        return (1 << bits) - far, far

    def settle(v: np.ndarray, shift: int) -> np.ndarray:
        return np.clip((v + add) >> shift if bits else turn(v), 0, 255)

    x0, x1, fx = taps(images.shape[2], width)
    y0, y1, fy = taps(images.shape[1], height)
    grid = images.astype(np.int64 if bits else float)
    near, far = weights(fx)
    mid = grid[:, :, x0] * near + grid[:, :, x1] * far
    mid = settle(mid, bits) if passes == 2 else mid
    near, far = (w[:, None] for w in weights(fy))
    return settle(mid[:, y0] * near + mid[:, y1] * far, bits * (3 - passes)).astype(np.int64)


def resize_sweep(cases: DataFrame, width: int, height: int, to_width: int, to_height: int, table: list[tuple] | None = None) -> DataFrame:
    """Formulations by how many cells of all cases they get wrong.

    ``cases``: grid and wanted, row-major arrays of whole numbers from 0 to 255.
    Returns passes, bits, first, add, how, mismatch (cells), worst (the largest
    share of a case, in percent), rank (1: fewest; equal ones in order of their
    parameters). A case of another size, or null, counts as wrong in every cell.
    Empty table: no rows.
    """
    table = table or formulations()
    cells = to_width * to_height

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fits = np.array([g is not None and w is not None and len(g) == width * height and len(w) == cells for g, w in zip(batch["grid"], batch["wanted"], strict=True)], bool)
            some = batch[fits]
            images = np.array(some["grid"].tolist(), np.int64).reshape(len(some), height, width)
            wanted = np.array(some["wanted"].tolist(), np.int64).reshape(len(some), to_height, to_width)
            for k, row in enumerate(table):
                wrong = (resize_by(images, to_width, to_height, *row) != wanted).sum((1, 2))
                broken = int((~fits).sum())
                yield pd.DataFrame({"k": [k], "mismatch": [int(wrong.sum()) + broken * cells], "most": [max(int(wrong.max(initial=0)), cells if broken else 0)]})

    told = cases.select("grid", "wanted").mapInPandas(run, "k int, mismatch long, most long").groupBy("k").agg(F.sum("mismatch").alias("mismatch"), F.max("most").alias("most"))
    rows = F.array(*(F.struct(F.lit(p).alias("passes"), F.lit(b).alias("bits"), F.lit(f).alias("first"), F.lit(a).alias("add"), F.lit(h).alias("how")) for p, b, f, a, h in table))
    order = Window.orderBy("mismatch", "passes", "bits", "first", "add", "how")  # a row a formulation
    told = told.select(F.get(rows, F.col("k")).alias("f"), "mismatch", (F.col("most") * 100.0 / cells).alias("worst")).select("f.*", "mismatch", "worst")
    return told.withColumn("rank", F.row_number().over(order))


# ---------------------------------------------------------------- the court


def around(mask: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells set in the square of ``size`` around each cell, and cells that it has inside the grid."""
    half, out = size // 2, []
    for grid in (mask.astype(np.int64), np.ones(mask.shape, np.int64)):
        total = np.pad(grid.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        y0, y1 = (np.clip(np.arange(mask.shape[0]) + o, 0, mask.shape[0]) for o in (-half, half + 1))
        x0, x1 = (np.clip(np.arange(mask.shape[1]) + o, 0, mask.shape[1]) for o in (-half, half + 1))
        out.append(total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)])
    return out[0], out[1]


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    return around(mask, size)[0] > 0


def erode(mask: np.ndarray, size: int) -> np.ndarray:
    """Cells whose square is set as far as it lies in the grid."""
    held, room = around(mask, size)
    return held == room


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (x, y) points, in order."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    chains = []
    for run in (points, points[::-1]):
        chain: list[np.ndarray] = []
        for p in run:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) <= (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]):
                chain.pop()
            chain.append(p)
        chains += chain[:-1]
    return np.array(chains)


def simplified(corners: np.ndarray, most: float) -> np.ndarray:
    """A closed polygon with fewer corners; none that is left out is farther than ``most`` from a side between its neighbours that stay."""
    if len(corners) < 4:
        return corners
    between = np.linalg.norm(corners[:, None] - corners[None], axis=2)
    i, j = sorted(np.unravel_index(between.argmax(), between.shape))

    def kept(line: np.ndarray) -> list[np.ndarray]:
        a, b = line[0].astype(float), line[-1].astype(float)
        along = (b - a) / np.linalg.norm(b - a)
        off = np.abs((line[1:-1] - a) @ np.array([-along[1], along[0]]))
        if not len(off) or off.max() <= most:
            return [line[0]]
        k = int(off.argmax()) + 1
        return kept(line[: k + 1]) + kept(line[k:])

    ring = np.roll(corners, -i, axis=0)
    return np.array(kept(ring[: j - i + 1]) + kept(np.r_[ring[j - i :], ring[:1]]))


def blurred(image: np.ndarray) -> np.ndarray:
    """Binomial blur of five cells in both directions, borders mirrored without their last cell."""
    out = image.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.arange(n)[:, None] + np.arange(-2, 3)
        at = np.abs(at) if n > 2 else np.clip(at, 0, n - 1)
        at = np.where(at >= n, 2 * (n - 1) - at, at)
        out = np.moveaxis(np.tensordot(np.moveaxis(out, axis, -1)[..., at], np.array([1, 4, 6, 4, 1]) / 16, 1), -1, axis)
    return np.rint(out)


def lab(image: np.ndarray) -> np.ndarray:
    """CIE L*a*b* (D65) of blue, green, red bytes."""
    c = image[..., ::-1].astype(float) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    # fixed values: sRGB primaries and its white
    xyz = c @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def clustered(points: np.ndarray, k: int, rounds: int = 40, tries: int = 5) -> np.ndarray:
    """Cluster of each point: k-means from spread-out starts, the best of some tries."""
    distinct, which = np.unique(points, axis=0, return_inverse=True)
    count = np.bincount(which.ravel()).astype(float)
    best = (np.inf, np.zeros(len(points), int))
    for t in range(tries):
        rng, centres = np.random.default_rng(t), []
        away = np.ones(len(distinct))
        for _ in range(min(k, len(distinct))):
            weight = away * count
            if not weight.sum():
                break
            centres.append(distinct[rng.choice(len(distinct), p=weight / weight.sum())])
            away = np.min([((distinct - c) ** 2).sum(1) for c in centres], 0)
        centres = np.array(centres)
        for _ in range(rounds):
            off = ((distinct[:, None] - centres[None]) ** 2).sum(2)
            mine = off.argmin(1)
            moved = np.array([np.average(distinct[mine == c], axis=0, weights=count[mine == c]) if (mine == c).any() else centres[c] for c in range(len(centres))])
            if np.abs(moved - centres).max() <= 0.2:
                break
            centres = moved
        cost = float((off.min(1) * count).sum())
        if cost < best[0]:
            best = (cost, mine[which.ravel()])
    return best[1]


def box(shape: tuple[int, int], shares: tuple[float, float, float, float]) -> tuple[slice, slice]:
    return slice(int(shape[0] * shares[0]), int(shape[0] * shares[1])), slice(int(shape[1] * shares[2]), int(shape[1] * shares[3]))


def court(image: np.ndarray, closing: int = CLOSING, opening: int = OPENING, clusters: int = CLUSTERS) -> tuple[np.ndarray, tuple[int, int]] | None:
    """Corners (x, y) of the floor in a median image (row, column, blue green red), and the columns that tracking keeps to.

    The floor is the cluster of colours most frequent in the lower middle; the
    component of it with the largest area, cells in the centre counted over,
    gives the hull. None where no component is left.
    """
    height, width = image.shape[:2]
    cluster = clustered(lab(blurred(image)).reshape(-1, 3), clusters).reshape(height, width)
    mask = cluster == np.bincount(cluster[box(image.shape, FLOOR_BOX)].ravel()).argmax()
    mask[: int(height * TOP)] = False
    mask = erode(dilate(mask, closing), closing)
    mask = dilate(erode(mask, opening), opening)
    label = labels(mask)
    if not label.max():
        return None
    centre = np.zeros_like(mask)
    centre[box(image.shape, CENTRE_BOX)] = True
    score = np.bincount(label.ravel()) + OVERLAP * np.bincount(label.ravel(), weights=centre.ravel())
    score[0] = -1
    best = len(score) - 1 - int(score[::-1].argmax())  # of equal ones the last
    corners = hull(outline(label == best)[:, ::-1])
    length = float(np.linalg.norm(corners - np.roll(corners, -1, axis=0), axis=1).sum())
    margin = round(width * MARGIN)
    return simplified(corners, STRAIGHT * length), (max(0, int(corners[:, 0].min()) - margin), min(width - 1, int(corners[:, 0].max()) + margin))


def court_regions(images: DataFrame, width: int, height: int, strips: int = 8, closing: int = CLOSING, opening: int = OPENING, clusters: int = CLUSTERS) -> DataFrame:
    """The court of each video from samples of its images.

    ``images``: video_id, image (row-major bytes, blue green red). The median of
    each cell (the upper one of an even number) is worked out in strips of rows,
    so that no task holds a video's samples whole. Returns video_id, floor
    (corners as shares of width and height, to five decimals) and the left and
    right end of the tracking envelope, which spans the whole height; null where
    there is no floor. Null images and those of another size have no part; a video
    without any other has no row.
    """
    sized = images.where("video_id is not null").where(F.octet_length("image") == width * height * 3).select("video_id", "image")
    deep = -(-height // strips)
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit((height - 1) // deep)), lambda s: F.struct(s.alias("strip"), F.substring(F.col("image"), s * deep * width * 3 + 1, F.lit(deep * width * 3)).alias("bytes"))))
    rows = sized.select("video_id", cut.alias("s")).select("video_id", "s.*")

    def median(part: pd.DataFrame) -> pd.DataFrame:
        values = np.stack([np.frombuffer(b, np.uint8) for b in part["bytes"]])
        middle = np.partition(values, len(values) // 2, axis=0)[len(values) // 2]
        return pd.DataFrame({"video_id": [part["video_id"].iloc[0]], "strip": [part["strip"].iloc[0]], "bytes": [middle.tobytes()]})

    def find(part: pd.DataFrame) -> pd.DataFrame:
        image = np.frombuffer(b"".join(part.sort_values("strip")["bytes"]), np.uint8).reshape(height, width, 3)
        found = court(image, closing, opening, clusters)
        floor, ends = (None, (None, None)) if found is None else ([[round(float(x) / width, 5), round(float(y) / height, 5)] for x, y in found[0]], tuple(round(e / width, 5) for e in found[1]))
        return pd.DataFrame({"video_id": [part["video_id"].iloc[0]], "floor": [floor], "left_end": [ends[0]], "right_end": [ends[1]]})

    strips_ = rows.groupBy("video_id", "strip").applyInPandas(median, "video_id long, strip int, bytes binary")
    return strips_.groupBy("video_id").applyInPandas(find, "video_id long, floor array<array<double>>, left_end double, right_end double")
