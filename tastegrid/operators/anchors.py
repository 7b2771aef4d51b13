"""Anchored sliders: a dead zone about the mean and a gain on either side, kept only if held-out rows agree.

All sums that a fit needs add up by dead zone and fold, so a pair of parameter and feature is three passes over blocks of
its rows, whatever its size: the sums, the errors of the fits that leave folds out, those of the fits chosen. Sessions are dealt to folds by
hash, SHUFFLES times over; the figures are means over these.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import moments

#: Fixed values of the method: fewest rows, dead zones in spreads, the tail's share, folds, deals of sessions to folds.
MIN_ROWS = 60
WIDTHS = (0.0, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0)
TAIL = 0.8
FOLDS, SHUFFLES = 5, 20
#: How far a tail may lie off the exact share of rows, as a share of them.
ACCURACY = 10_000
#: Deals of three bits that a double holds; rows whose figures are made at once.
PER_CODE, PART_ROWS = 17, 1 << 12
SUMS = ("n", "up", "down", "up2", "down2", "y", "upy", "downy")


def _sums(x: Column, y: Column, width: float) -> list[Column]:
    """n, and sums of max(x - width, 0), min(x + width, 0), their squares, y, and their products with y."""
    up, down = F.greatest(x - width, F.lit(0.0)), F.least(x + width, F.lit(0.0))
    return [F.count(F.lit(1)), F.sum(up), F.sum(down), F.sum(up * up), F.sum(down * down), F.sum(y), F.sum(up * y), F.sum(down * y)]


def sums(rows: DataFrame, keys: list[str], widths=WIDTHS) -> DataFrame:
    """rows (keys, fold, x, y): (keys, fold, width, and SUMS). A row's part in all widths is added up at once."""
    each = [F.struct(F.lit(w).alias("width"), *[s.alias(n) for s, n in zip(_sums(F.col("x"), F.col("y"), w), SUMS, strict=True)]) for w in widths]
    return rows.groupBy(*keys, "fold").agg(*[e.alias(f"_w{i}") for i, e in enumerate(each)]).select(*keys, "fold", F.inline(F.array(*[f"_w{i}" for i in range(len(widths))])))


def solved(s: np.ndarray) -> np.ndarray:
    """(base, above, below) from SUMS; the two sides of a dead zone never meet in one row."""
    n, up, down, up2, down2, y, upy, downy = s
    a = np.array([[n, up, down], [up, up2, 0.0], [down, 0.0, down2]])
    return np.linalg.solve(a + np.eye(3) * 1e-9, np.array([y, upy, downy]))


def _chosen(errors: dict[float, float]) -> float:
    """The widest dead zone among those with the least error."""
    least = min(errors.values())
    return max(w for w, e in errors.items() if e <= least * (1 + 1e-9))


def fits(samples: DataFrame, shuffles: int = SHUFFLES) -> DataFrame:
    """samples (param, feature, x, y, session): for each pair with rows enough and a feature that varies, its dead zone,
    base and gains from all rows, mean and tail skill over held-out sessions, and whether it is kept. The dead zone is
    chosen within the training folds, so no fold chooses its own. Pairs are few: a catalogue's parameters by features."""
    keys = ["param", "feature"]
    at = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("x").alias("_mx"), F.stddev_pop("x").alias("_sx"), F.avg("y").alias("_my"))
    at = _told(at.filter((F.col("_n") >= MIN_ROWS) & (F.col("_sx") >= 1e-9)))
    off = F.abs(F.col("y") - F.col("_my"))
    tails = samples.join(F.broadcast(at), keys).groupBy(*keys).agg(F.percentile_approx(off, TAIL, ACCURACY).alias("_cut"))
    facts = _told(at.join(tails, keys))
    # all folds of a row are few numbers: three bits a deal, so many deals a number as a double holds exactly
    deals = [F.pmod(F.xxhash64(F.col("session"), F.lit(k)), F.lit(FOLDS)) for k in range(shuffles)]
    codes = [reduce(lambda a, b: a + b, [F.shiftleft(d, 3 * i) for i, d in enumerate(deals[lo : lo + PER_CODE])]) for lo in range(0, shuffles, PER_CODE)]
    rows = samples.join(F.broadcast(facts), keys).withColumn("x", (F.col("x") - F.col("_mx")) / F.col("_sx")).withColumn("_off", off)
    z = F.array("x", "y", "_off", (F.col("_off") >= F.col("_cut")).cast("double"), *[c.cast("double") for c in codes])
    named = F.concat_ws("\u0001", *keys)
    width = 4 + len(codes)
    blocks = moments.packed(rows.select(named.alias("key"), z.alias("z")), width).persist()
    try:
        out = _fitted(blocks, width, shuffles)
    finally:
        blocks.unpersist()
    return samples.sparkSession.createDataFrame(out, "param string, feature string, n long, width double, base double, above double, below double, mean_skill double, tail_skill double, kept boolean")


def _told(facts: DataFrame) -> DataFrame:
    """Facts by pair, computed once: pairs are few."""
    return facts.sparkSession.createDataFrame(facts.collect(), facts.schema)


def _fitted(blocks: DataFrame, width: int, shuffles: int) -> list[tuple]:
    name = lambda pair: "\u0001".join(pair)
    cells: dict[tuple, dict] = {}
    for key, (_, v) in moments.sums_of_blocks(blocks, width, _fold_sums(shuffles)).items():
        by = v.reshape(shuffles, FOLDS, len(WIDTHS), len(SUMS))
        for (s, f, w), part in np.ndenumerate(by[..., 0]):
            if part:
                cells.setdefault(tuple(key.split("\u0001")), {})[s, f, WIDTHS[w]] = by[s, f, w]
    pairs = sorted(cells)
    inner = {k: v.reshape(shuffles, FOLDS + 1, len(WIDTHS)) for k, (_, v) in moments.sums_of_blocks(blocks, width, _inner_errors(blocks, {name(p): _left_out(cells[p], shuffles) for p in pairs})).items()}
    held = {name(p): _held_fits(cells[p], inner[name(p)], shuffles) for p in pairs}
    rated = {k: v for k, (_, v) in moments.sums_of_blocks(blocks, width, _held_errors(blocks, held)).items()}
    out = []
    for pair in pairs:
        at_all = inner[name(pair)][:, FOLDS].sum(axis=0)
        dead = _chosen(dict(zip(WIDTHS, at_all.tolist(), strict=True)))
        total = reduce(np.add, [v for (s, _, w), v in cells[pair].items() if s == 0 and w == dead])
        off, tail, *each = rated[name(pair)]
        skill = lambda e, base: float(np.mean(1 - e / max(base, 1e-9)))
        figures = skill(np.array(each[:shuffles]), off), skill(np.array(each[shuffles:]), tail)
        out.append((*pair, int(total[0]), dead, *map(float, solved(total)), *figures, min(figures) > 0))
    return out


def _folds(z: np.ndarray, shuffles: int) -> np.ndarray:
    """(shuffle, row): the folds that rows' codes hold."""
    codes = z[:, 4:].T.astype(np.int64)
    return np.stack([codes[s // PER_CODE] >> 3 * (s % PER_CODE) & 7 for s in range(shuffles)])


def _shape(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(width, row): how far a row is above and below each dead zone."""
    x, w = np.ascontiguousarray(z[:, 0]), np.array(WIDTHS)[:, None]
    return np.maximum(x - w, 0), np.minimum(x + w, 0)


def _parts(z: np.ndarray):
    """Rows in parts whose figures stay near the processor."""
    return (z[at : at + PART_ROWS] for at in range(0, len(z), PART_ROWS))


def _fold_sums(shuffles: int):
    """(shuffle, fold, width, SUMS) of rows (x, y, ..., codes of folds)."""

    def add(key: str, z: np.ndarray, _: np.ndarray) -> np.ndarray:
        out = np.zeros((shuffles * FOLDS, len(WIDTHS) * len(SUMS)))
        for part in _parts(z):
            (up, down), y = _shape(part), part[:, 1]
            each = np.stack([np.broadcast_to(v, up.shape) for v in (np.ones(len(y)), up, down, up * up, down * down, y, up * y, down * y)], axis=1)
            mine = _folds(part, shuffles)[:, None] == np.arange(FOLDS)[:, None]
            out += mine.reshape(len(out), -1).astype(float) @ each.reshape(out.shape[1], -1).T
        return out.ravel()

    return add


def _left_out(cells: dict, shuffles: int) -> np.ndarray:
    """(shuffle, left, fold, width, 3): fits without the row's own fold and the one that is left out beside it, the last
    place leaving out none; not a number where too few folds are left."""
    out = np.full((shuffles, FOLDS + 1, FOLDS, len(WIDTHS), 3), np.nan)
    for s in range(shuffles):
        for i, w in enumerate(WIDTHS):
            by = {f: v for (k, f, x), v in cells.items() if k == s and x == w}
            whole = reduce(np.add, by.values())
            for left in (*by, FOLDS):
                rest = set(by) - {left}
                for g in rest if len(rest) > 1 else ():
                    out[s, left, g, i] = solved(whole - by[g] - by.get(left, 0))
    return out


def _held_fits(cells: dict, inner: np.ndarray, shuffles: int) -> np.ndarray:
    """(shuffle, fold, 4): the dead zone that a fold's training rows choose, and the fit to them."""
    out = np.full((shuffles, FOLDS, 4), np.nan)
    for s in range(shuffles):
        used = {f for k, f, _ in cells if k == s}
        for f in used if len(used) > 1 else ():
            w = _chosen(dict(zip(WIDTHS, inner[s, f].tolist(), strict=True))) if len(used) > 2 else 0.0
            whole = reduce(np.add, [v for (k, _, x), v in cells.items() if k == s and x == w])
            out[s, f] = (w, *solved(whole - cells[s, f, w]))
    return out


def _inner_errors(df: DataFrame, fits_: dict[str, np.ndarray]):
    shared = df.sparkSession.sparkContext.broadcast(fits_)

    def add(key: str, z: np.ndarray, _: np.ndarray) -> np.ndarray:
        table = shared.value[key]
        out = np.zeros((len(table), FOLDS + 1, len(WIDTHS)))
        for part in _parts(z):
            up, down = _shape(part)
            one, y = np.ones_like(up), np.broadcast_to(part[:, 1], up.shape)
            shape = np.stack((one, up, down, -y), axis=1)
            for s, fold in enumerate(_folds(part, len(table))):
                order = np.argsort(fold, kind="stable")
                cuts = np.searchsorted(fold[order], np.arange(FOLDS + 1))
                sorted_ = shape[:, :, order]
                for g, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if lo < hi:
                        # (width, left, 4) by (width, 4, row): what the fits that leave this fold out are off
                        fits_of = np.concatenate((table[s, :, g], np.ones((FOLDS + 1, len(WIDTHS), 1))), axis=2).transpose(1, 0, 2)
                        missed = fits_of @ sorted_[:, :, lo:hi]
                        out[s] += np.nan_to_num(np.abs(missed, out=missed).sum(axis=2)).T
        return out.ravel()

    return add


def _held_errors(df: DataFrame, fits_: dict[str, np.ndarray]):
    """Sums of the distances from the mean of all rows and of the tail, then of the held-out errors of either by deal."""
    shared = df.sparkSession.sparkContext.broadcast(fits_)

    def add(key: str, z: np.ndarray, _: np.ndarray) -> np.ndarray:
        table, x, y, off, tail = shared.value[key], z[:, 0], z[:, 1], z[:, 2], z[:, 3]
        out, far = [off.sum(), (off * tail).sum()], []
        for s, fold in enumerate(_folds(z, len(table))):
            w, base, above, below = table[s][fold].T
            missed = np.abs(y - base - above * np.maximum(x - w, 0) - below * np.minimum(x + w, 0))
            missed = np.where(np.isnan(missed), off, missed)
            out.append(missed.sum())
            far.append((missed * tail).sum())
        return np.array(out + far)

    return add
