"""Whether edits are one style or a mixture: one linear model of all frames against a model for each cluster of styles.

For every number of clusters the frames are clustered by how they were edited, and a frame's cluster is known even when
it is held out; so the clustered skill says what a router that never errs could gain. Every round of clustering is one
pass over the styles for all numbers of clusters. One pass collects moments by (clusters, cluster, fold), one sums the
errors of all models and penalties; neither grows with the number of models.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate, folds, moments

#: A target counts if it weighs this much; a fold needs this many rows for each of its sets; rounds of clustering (fixed
#: values).
LEAST_WEIGHT, ROWS_PER_FOLD, ROUNDS = 1.5, 3, 60
#: Passes that draw where centres start, rounds in which the drawn rows are clustered, and the move below which a centre
#: stands still (fixed values).
STARTS, LOCAL_ROUNDS, STILL = 3, 30, 1e-4
#: Styles that a round takes up at once.
BLOCK_ROWS = 1 << 14
LEAST_SPREAD, LEAST_ERROR = 1e-6, 1e-9


@dataclass
class Diagnosis:
    """skills: a row per number of clusters (1: pooled) with the weighted skill against the mean edit of all frames.
    clusters: a row per cluster with its frames, penalty (null: too few frames, their mean stands in) and mean style."""

    skills: list[tuple[int, float | None]]
    clusters: list[tuple[int, int, int, float | None, list[float]]]

    def gain(self) -> float | None:
        """What the best clustering gains on the pooled model."""
        pooled = self.skills[0][1]
        rest = [s for _, s in self.skills[1:] if s is not None]
        return max(rest) - pooled if rest and pooled is not None else None


def _weighted(model: np.ndarray, base: np.ndarray, weights: np.ndarray) -> float | None:
    """The weighted mean of the targets' skills, of those that weigh enough and vary."""
    told = (weights >= LEAST_WEIGHT) & (base > LEAST_ERROR)
    return float(((1 - model[told] / base[told]) * weights[told]).sum() / weights[told].sum()) if told.any() else None


def _nearest(z: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centre of each row, the lowest number on ties; its squared distance)."""
    columns = np.ascontiguousarray(z.T)
    place, best = np.zeros(len(z), dtype=int), np.full(len(z), np.inf)
    for j, centre in enumerate(centres):
        far = np.zeros(len(z))
        for column, at in zip(columns, centre, strict=True):
            off = column - at
            off *= off
            far += off
        np.putmask(place, far < best, j)
        np.minimum(best, far, out=best)
    return place, best


def _draws(z: np.ndarray, seed: int) -> np.ndarray:
    """A number within (0, 1) for each row, the same for equal rows wherever they lie: a hash of the row's bits."""
    with np.errstate(over="ignore"):
        h = np.full(len(z), seed, dtype=np.uint64)
        for column in z.T:
            h = (h ^ (column + 0.0).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _first(keys: np.ndarray, z: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most rows of the least keys; rows of one key are equal and count once."""
    keys, at = np.unique(keys, return_index=True)
    return keys[:most], z[at[:most]]


def _passed(styles: DataFrame, d: int, start, step, tell) -> list[bytes]:
    """What each task tells of its blocks of d columns, after a step for each block from start on."""

    def told(batches):
        held = start
        for batch in batches:
            for _, z in moments.unpacked(batch, d):
                held = step(held, z)
        yield pa.RecordBatch.from_pydict({"told": [] if held is start else [tell(held)]}, schema=pa.schema([("told", pa.binary())]))

    return [bytes(r["told"]) for r in styles.mapInArrow(told, "told binary").collect()]


def _drawn(styles: DataFrame, d: int, centres: dict[int, np.ndarray], seed: int) -> dict[int, np.ndarray]:
    """For each number of clusters twice as many rows, drawn with chances that go by their squared distance from the
    centres so far (none: any row), by hash."""
    most = {c: 2 * c if len(at) else 1 for c, at in centres.items()}

    def step(held, z):
        u, out = _draws(z, seed), {}
        for c, at in centres.items():
            far = _nearest(z, at)[1] if len(at) else np.ones(len(z))
            some = far > 0
            keys, rows = _first(-np.log(u[some]) / far[some], z[some], most[c])
            if held is not None:
                keys, rows = _first(np.concatenate((held[c][0], keys)), np.concatenate((held[c][1], rows)), most[c])
            out[c] = keys, rows
        return out

    found = [pickle.loads(raw) for raw in _passed(styles, d, None, step, pickle.dumps)]
    return {c: np.concatenate((at, _first(*(np.concatenate([f[c][i] for f in found]) for i in (0, 1)), most[c])[1])) for c, at in centres.items()}


def _moments_of(styles: DataFrame, d: int, centres: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each number of clusters, by centre, the rows that are nearest to it and the sums of their columns."""

    def step(held, z):
        out = {}
        for c, at in centres.items():
            place = _nearest(z, at)[0]
            out[c] = np.stack([np.bincount(place, weights=v, minlength=len(at)) for v in (np.ones(len(z)), *z.T)], axis=1)
        return out if held is None else {c: held[c] + v for c, v in out.items()}

    found = [pickle.loads(raw) for raw in _passed(styles, d, None, step, pickle.dumps)]
    return {c: sum(f[c] for f in found) for c in centres}


def _seeded(rows: np.ndarray, weights: np.ndarray, c: int, rnd: np.random.Generator) -> np.ndarray:
    """c centres of few weighted rows: drawn by their distance from those before, then moved to their rows' means."""
    centres = rows[[rnd.choice(len(rows), p=weights / weights.sum())]]
    while len(centres) < min(c, len(rows)):
        far = weights * _nearest(rows, centres)[1]
        centres = np.vstack((centres, rows[rnd.choice(len(rows), p=far / far.sum()) if far.sum() > 0 else rnd.choice(len(rows))]))
    for _ in range(LOCAL_ROUNDS):
        place = _nearest(rows, centres)[0]
        mass = np.bincount(place, weights=weights, minlength=len(centres))
        mean = np.stack([np.bincount(place, weights=weights * v, minlength=len(centres)) for v in rows.T], axis=1) / np.maximum(mass, LEAST_ERROR)[:, None]
        centres = np.where(mass[:, None] > 0, mean, centres)
    return centres


def _clustered(styles: DataFrame, d: int, clusters: tuple[int, ...], seed: int) -> dict[int, np.ndarray]:
    """The centres for each number of clusters: the same pass over all rows serves all of them. Starts are drawn in
    STARTS passes from all rows by distance, weighed by the rows nearest to them, and clustered; then all rows move the
    centres until none moves by more than STILL. A cluster that loses all rows keeps its centre."""
    centres = {c: np.zeros((0, d)) for c in clusters}
    for i in range(STARTS):
        centres = _drawn(styles, d, centres, seed + i)
    weights = {c: v[:, 0] for c, v in _moments_of(styles, d, centres).items()}
    done, moving = {}, {c: _seeded(at, weights[c], c, np.random.default_rng(seed)) for c, at in centres.items()}
    for _ in range(ROUNDS):
        if not moving:
            break
        for c, sums in _moments_of(styles, d, moving).items():
            centre = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1), moving[c])
            still = (((centre - moving[c]) ** 2).sum(axis=1) <= STILL**2).all()
            moving[c] = centre
            if still:
                done[c] = moving.pop(c)
    return done | moving


def diagnosed(frames: DataFrame, session: str, x: str, y: str, style: str, weights: list[float], *, clusters: tuple[int, ...] = (2, 3, 4), k: int = 5, penalties: tuple[float, ...] = evaluate.PENALTIES, emphasis: list[float] | None = None, seed: int = 7) -> Diagnosis:
    """frames (session, features x, edits y, style, how they were edited): skills and clusters. Sessions are held out
    whole, in the same folds throughout. Too few frames for the folds raise. Frames are held as blocks of numbers by
    fold, their styles once more beside them, which is all that the rounds of clustering read."""
    n = frames.count()
    if n < ROWS_PER_FOLD * k:
        raise ValueError(f"{n} frames are too few for {k} folds of {ROWS_PER_FOLD} each")
    own = frames.select(F.col(session).alias("_session"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(style).alias("_s"))
    first = own.limit(moments.CENTRE_ROWS).collect()
    d, t, e = (len(first[0][c]) for c in ("_x", "_y", "_s"))
    whole = np.array([[*r["_x"], *r["_y"], *r["_s"]] for r in first if (len(r["_x"]), len(r["_y"]), len(r["_s"])) == (d, t, e)], dtype=float)
    if d + t + e > moments.MAX_COLUMNS or (1 + sum(clusters)) * k * (d + t + e + 1) ** 2 * 8 > moments.MAX_BYTES:
        raise ValueError(f"at most {moments.MAX_COLUMNS} columns, and {moments.MAX_BYTES} bytes of moments")
    rows = folds.dealt(own, "_session", k).select(F.col("fold").cast("string").alias("key"), F.concat("_x", "_y", "_s").alias("z"))
    blocks = moments.packed(rows, d + t + e).persist()
    styles = None
    try:
        centre = np.nan_to_num(whole.mean(axis=0))
        m = moments.total({g: moments.Moments(c, v.reshape(len(centre) + 1, -1), centre, d) for g, (c, v) in moments.sums_of_blocks(blocks, d + t + e, moments.products(centre)).items()})
        mean, spread = m.mean[d + t :], np.maximum(np.sqrt(np.maximum(np.diag(m.covariance)[d + t :], 0) / max(m.weight, 1.0)), LEAST_SPREAD)
        # seven digits, which do not depend on the order of sums, so that equal rows stay equal and are drawn alike
        mean, factor = (np.array([float(f"{v:.7g}") for v in row]) for row in (mean, np.array(emphasis if emphasis is not None else np.ones(e)) / spread))
        scaled = lambda z: (z[:, d + t :] - mean) * factor

        def narrow(batches):
            for batch in batches:
                whole = np.concatenate([scaled(z) for _, z in moments.unpacked(batch, d + t + e)] or [np.zeros((0, e))])
                parts = [whole[at : at + BLOCK_ROWS].tobytes() for at in range(0, len(whole), BLOCK_ROWS)]
                yield pa.RecordBatch.from_pydict({"key": ["all"] * len(parts), "block": parts}, schema=moments.BLOCKS)

        styles = blocks.mapInArrow(narrow, "key string, block binary").persist()
        centres = _clustered(styles, e, clusters, seed)
        styles.unpersist()
        sets = [(1, 0), *((c, j) for c in clusters for j in range(len(centres[c])))]

        def split(z: np.ndarray):
            """The rows of each of the sets, in their order."""
            yield z
            for c in clusters:
                place = _nearest(scaled(z), centres[c])[0]
                yield from (z[place == j] for j in range(len(centres[c])))

        return _judged(blocks, d, t, sets, split, centre, np.array(weights, dtype=float), clusters, k, penalties)
    finally:
        for held in (blocks, styles):
            if held is not None:
                held.unpersist()


def _judged(blocks: DataFrame, d: int, t: int, sets: list[tuple[int, int]], split, centre: np.ndarray, weights: np.ndarray, clusters: tuple[int, ...], k: int, penalties: tuple[float, ...]) -> Diagnosis:
    width = len(centre)
    grams = moments.products(centre)
    parts = moments.sums_of_blocks(blocks, width, lambda key, z, w: np.concatenate([grams(key, own, np.ones(len(own))) for own in split(z)]))
    by: dict[tuple[int, int], dict[str, moments.Moments]] = {}
    for fold, (_, found) in parts.items():
        for of, gram in zip(sets, found.reshape(len(sets), width + 1, width + 1), strict=True):
            if gram[0, 0]:
                by.setdefault(of, {})[fold] = moments.Moments(int(gram[0, 0]), gram, centre, d)
    everything = moments.total(by[1, 0])
    overall = everything.mean[d : d + t]
    zero = np.zeros((d, t))
    models: dict[tuple[str, int, int], tuple[np.ndarray, np.ndarray]] = {}
    large: dict[tuple[int, int], bool] = {}
    for (c, j), folded in by.items():
        whole = moments.total(folded)
        own = whole.mean[d : d + t]
        large[c, j] = whole.n >= ROWS_PER_FOLD * k
        for fold, part in folded.items():
            rest = (whole - part).picked(slice(None), slice(0, t))
            fits = [moments.ridge(rest, p, per_weight=True, standardised=True) if large[c, j] and rest.n >= 2 else (zero, own) for p in penalties]
            fits = [(zero, overall), (zero, own), *fits]
            models[fold, c, j] = np.concatenate([b for b, _ in fits], axis=1), np.concatenate([i for _, i in fits])
    shared = blocks.sparkSession.sparkContext.broadcast(models)

    def missed(key: str, z: np.ndarray, _: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), (2 + len(penalties)) * t))
        for i, (of, own) in enumerate(zip(sets, split(z), strict=True)):
            if len(own):
                b, c = shared.value[key, *of]
                out[i] = np.abs((own[:, :d] @ b + c).reshape(len(own), -1, t) - own[:, None, d : d + t]).sum(axis=0).ravel()
        return out.ravel()

    errors = {(fold, *of): e for fold, (_, v) in moments.sums_of_blocks(blocks, width, missed).items() for of, e in zip(sets, v.reshape(len(sets), -1), strict=True)}
    skills, told = [], []
    for c in (1, *clusters):
        model = base = np.zeros(t)
        for (of, j), folded in sorted(by.items()):
            if of != c:
                continue
            off = sum(errors[fold, c, j] for fold in folded).reshape(-1, t)
            against, own, tried = off[0], off[1], off[2:]
            gains = [_weighted(e, own, weights) for e in tried]
            pick = max(range(len(penalties)), key=lambda i: (-np.inf if gains[i] is None else gains[i], penalties[i]))
            model, base = model + (tried[pick] if large[c, j] else own), base + against
            whole = moments.total(folded)
            told.append((c, j, whole.n, float(penalties[pick]) if large[c, j] else None, whole.mean[d + t :].tolist()))
        skills.append((c, _weighted(model, base, weights)))
    return Diagnosis(skills, sorted(told, key=lambda r: (r[0], -r[2], r[1])))
