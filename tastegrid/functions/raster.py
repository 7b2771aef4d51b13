"""Raster kernels and codecs: numpy over Arrow batches, an image a row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TILES, LEAST_TILE = 8, 16


def laplacian_variance(image: np.ndarray) -> float:
    """The variance of the four-neighbour Laplacian; an image under three pixels a side has none."""
    if min(image.shape) < 3:
        raise ValueError("an image needs three pixels a side")
    x = image.astype(np.float64)
    lap = x[1:-1, :-2] + x[1:-1, 2:] + x[:-2, 1:-1] + x[2:, 1:-1] - 4 * x[1:-1, 1:-1]
    return float(lap.var())


def focus_tiles(image: np.ndarray) -> np.ndarray:
    """Laplacian variance by tile, as many as fit at LEAST_TILE pixels, at most TILES a side."""
    rows, cols = (max(1, min(TILES, n // LEAST_TILE)) for n in image.shape)
    edges = lambda n, k: [n * i // k for i in range(k + 1)]
    ys, xs = edges(image.shape[0], rows), edges(image.shape[1], cols)
    return np.array([[laplacian_variance(image[a:b, c:d]) for c, d in zip(xs, xs[1:], strict=False)] for a, b in zip(ys, ys[1:], strict=False)])


def focus(images: DataFrame) -> DataFrame:
    """images (vec_id, pixels, width, height): score, tiles and peak."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, pixels, width, height in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = np.array(pixels).reshape(height, width)
                tiles = focus_tiles(image)
                top = np.sort(tiles.ravel())[::-1][: max(1, int(tiles.size * 0.05 + 0.5))]
                rows.append({"vec_id": key, "score": laplacian_variance(image), "tiles": tiles.ravel().tolist(), "peak": float(top.mean())})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("vec_id", pa.int64()), ("score", pa.float64()), ("tiles", pa.list_(pa.float64())), ("peak", pa.float64())]))

    return images.mapInArrow(run, "vec_id long, score double, tiles array<double>, peak double")


#: Photometric figures (fixed values): luma weights, bins of the luma and hue histograms, the ends of the scale from
#: which all channels count as clipped, the largest Laplacian of 8-bit values.
LUMA, LUMA_BINS, HUE_BINS, CLIP_HIGH, CLIP_LOW, MOST_LAPLACIAN = (0.2126, 0.7152, 0.0722), 16, 12, 250, 4, 1020
FEATURES = (
    "luma_mean luma_median luma_std " + " ".join(f"luma_hist_{i}" for i in range(LUMA_BINS)) + " clip_high clip_low red_mean green_mean blue_mean red_std green_std blue_std red_green blue_green "
    "saturation_mean saturation_std value_mean " + " ".join(f"hue_hist_{i}" for i in range(HUE_BINS)) + " luma_p01 luma_p99 shadow_floor detail_fine detail_coarse dark_channel"
).split()


def _share_rank(levels: np.ndarray, share: float) -> float:
    """The first of 256 levels up to which a share of the values lies."""
    return float(np.searchsorted(np.cumsum(np.bincount(levels, minlength=256)), len(levels) * share, side="left"))


def _detail(plane: np.ndarray) -> float:
    """Mean absolute Laplacian over the largest possible; planes under three pixels a side have none."""
    if min(plane.shape) < 3:
        return 0.0
    lap = 4 * plane[1:-1, 1:-1] - plane[1:-1, :-2] - plane[1:-1, 2:] - plane[:-2, 1:-1] - plane[2:, 1:-1]
    return float(np.abs(lap).mean()) / MOST_LAPLACIAN


def photometric(rgb: np.ndarray) -> np.ndarray:
    """FEATURES of an image (height, width, 3) of 8-bit values, to six places."""
    flat = rgb.reshape(-1, 3).astype(float)
    plane = (rgb.astype(float) @ np.array(LUMA)).astype(np.float32).astype(float)
    levels = np.minimum(255, np.floor(flat @ np.array(LUMA))).astype(int)
    counts = np.bincount(levels, minlength=256)
    top, low = flat.max(axis=1) / 255, flat.min(axis=1) / 255
    span = top - low
    r, g, b = flat.T / 255
    with np.errstate(divide="ignore", invalid="ignore"):
        sector = np.where(top == r, np.fmod((g - b) / span, 6), np.where(top == g, (b - r) / span + 2, (r - g) / span + 4))
        hue = np.where(span == 0, 0.0, sector / 6)
        saturation = np.where(top == 0, 0.0, span / top)
    hue = np.where(hue < 0, hue + 1, hue)
    hues = np.bincount(np.minimum(HUE_BINS - 1, np.floor(hue * HUE_BINS)).astype(int), saturation, HUE_BINS) / len(flat)
    means, spread = flat.mean(axis=0), flat.std(axis=0)
    ratios = means[[0, 2]] / means[1] if means[1] > 1 else np.ones(2)
    level_mean = (np.arange(256) * counts).sum() / len(flat)
    level_std = np.sqrt(max(0.0, (np.arange(256) ** 2 * counts).sum() / len(flat) - level_mean**2))
    h, w = plane.shape[0] // 2, plane.shape[1] // 2
    coarse = plane[: 2 * h, : 2 * w].reshape(h, 2, w, 2).mean(axis=(1, 3)) if h and w else np.zeros((1, 1))
    figures = [
        level_mean / 255, _share_rank(levels, 0.5) / 255, level_std / 255, *(counts.reshape(LUMA_BINS, -1).sum(axis=1) / len(flat)), (flat.min(axis=1) >= CLIP_HIGH).mean(), (flat.max(axis=1) <= CLIP_LOW).mean(), *(means / 255), *(spread / 255), *ratios,
        saturation.mean(), saturation.std(), top.mean(), *hues, _share_rank(levels, 0.01) / 255, _share_rank(levels, 0.99) / 255, _share_rank(np.minimum(255, np.floor(coarse.ravel())).astype(int), 0.05) / 255, _detail(plane), _detail(coarse), low.mean(),
    ]
    return np.floor(np.array(figures) * 1e6 + 0.5) / 1e6


def photometry(images: DataFrame) -> DataFrame:
    """images (vec_id, r, g, b, width, height): FEATURES of each."""

    def run(batches):
        for batch in batches:
            found = [photometric(np.array([r, g, b]).T.reshape(h, w, 3)).tolist() for r, g, b, w, h in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["vec_id", "features"])

    return images.select("vec_id", "r", "g", "b", "width", "height").mapInArrow(run, "vec_id long, features array<double>")


def regional(pixels: np.ndarray, tiles: np.ndarray, share: float = 0.5) -> dict[str, float]:
    """Luma (0 to 255) of a subject, the tiles whose focus is at least a share of the sharpest, against the whole: mean,
    5th and 95th percentile, and the shares that are clipped at either end."""
    rows, cols = tiles.shape
    at = np.kron(tiles >= share * tiles.max(), np.ones((-(-pixels.shape[0] // rows), -(-pixels.shape[1] // cols)), dtype=bool))[: pixels.shape[0], : pixels.shape[1]]
    out: dict[str, float] = {}
    for name, part in (("subject", pixels[at]), ("whole", pixels.ravel())):
        part = np.sort(part.astype(float))
        rank = lambda p, part=part: float(part[int(p * (len(part) - 1) + 0.5)])
        out |= {f"{name}_mean": float(part.mean()), f"{name}_p05": rank(0.05), f"{name}_p95": rank(0.95), f"{name}_high": float((part >= CLIP_HIGH).mean()), f"{name}_low": float((part <= CLIP_LOW).mean())}
    return out


def polygon(points: np.ndarray, side: int) -> np.ndarray:
    """A mask of side x side pixel centres inside the polygon, by the even-odd rule."""
    y, x = np.mgrid[0:side, 0:side] + 0.5
    inside = np.zeros((side, side), dtype=bool)
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, axis=0), strict=True):
        if ay != by:
            inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def polygon_share(shapes: DataFrame, side: int) -> DataFrame:
    """shapes (p_partkey, points as x, y, ...): the share of the grid that each covers."""

    def run(batches):
        for batch in batches:
            keys, points = (c.to_pylist() for c in batch.columns)
            share = [float(polygon(np.array(p).reshape(-1, 2), side).mean()) for p in points]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(share, pa.float64())], names=["p_partkey", "share"])

    return shapes.mapInArrow(run, "p_partkey long, share double")


def codec(vectors: DataFrame, width: int) -> DataFrame:
    """vectors (vec_id, embedding): float32 bytes, and whether they read back as the same vector of the width."""

    def run(batches):
        for batch in batches:
            keys, rows = (c.to_pylist() for c in batch.columns)
            data = [np.array(v, dtype="<f4").tobytes() for v in rows]
            same = [len(d) == 4 * width and np.frombuffer(d, dtype="<f4").tolist() == v for d, v in zip(data, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary()), pa.array(same)], names=["vec_id", "bytes", "same"])

    return vectors.mapInArrow(run, "vec_id long, bytes binary, same boolean")
