"""Tone solving: controls that give a frame the look asked for, or that keep its look within bounds; intents as bounds.

A frame is a histogram: `stops` with `weights`, its white `anchor`, and, for bounds on parts of it, `regions`, a map of
names to the weights of that part on the same stops. Searches run in the tasks, a frame at a time in numpy, on whole
arrays of trials; batches are cut so that a task holds few frames at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import look as L

#: How far each control may go, in the order of look.CONTROLS (fixed values).
LIMIT = np.array([3.0, 1.0, 1.0, 1.0, 1.0, 1.0])
#: What a full move of a control costs, in squared code values: towards a look, and within bounds (fixed values).
STIFFNESS, BOUND_STIFFNESS = 4.0, 25.0
#: Places of a control in the coarse sweep, sweeps that are followed up, and steps of the search.
SWEEP, FOLLOWED = 9, 8
COARSE, FINE, LAST = 0.25, 0.03, 1e-3
#: A bound counts as met within so many squared code values.
MET = 1e-6
#: Frames that a task turns into arrays at once.
FRAMES = 256


def _smooth(x: np.ndarray, low: float, high: float) -> np.ndarray:
    t = np.clip((x - low) / (high - low), 0, 1)
    return t * t * (3 - 2 * t)


def shaped(stops: np.ndarray, anchor: float, trials: np.ndarray) -> np.ndarray:
    """(trials, stops): log2 luminance after each trial's controls."""
    # exposure moves stops and white alike, so where the other controls act is the same in every trial
    away, (exposure, contrast) = stops - anchor, (c[:, None] for c in trials.T[:2])
    moves = (
        L.HIGHLIGHT_RANGE * np.clip(away - L.HIGHLIGHT_PIVOT, 0, L.MOST_STOPS), L.SHADOW_RANGE * np.clip(L.SHADOW_PIVOT - away, 0, L.MOST_STOPS),
        L.WHITE_STOPS * _smooth(away, *L.WHITES), L.BLACK_STOPS * (1 - _smooth(away, *L.BLACKS)),
    )
    grey = anchor + exposure + L.GREY
    return grey + (away - L.GREY + sum(c[:, None] * m for c, m in zip(trials.T[2:], moves, strict=True))) * (1 + contrast * L.CONTRAST_RANGE)


def shown(log: np.ndarray) -> np.ndarray:
    """Log2 luminance as a display shows it; it rises with luminance (but for 3e-8 at its joint)."""
    y = np.minimum(1.0, np.exp2(log))
    e = np.where(y <= 0.0031308, y * 12.92, np.power(y, 1 / 2.4) * 1.055 - 0.055)
    return e + (e * e * (3 - 2 * e) - e) * L.DISPLAY_CONTRAST


def displayed(stops: np.ndarray, anchor: float, trials: np.ndarray) -> np.ndarray:
    """(trials, stops): display values after each trial's controls."""
    return shown(shaped(stops, anchor, trials))


def looks(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(trials, percentiles): weighted lower percentiles of each trial's values."""
    held = weights > 0
    values, weights = values[:, held], weights[held]
    order = np.argsort(values, axis=1, kind="stable")
    upto = np.cumsum(weights[order], axis=1)
    out = np.empty((len(values), len(L.PERCENTILES)))
    rows = np.arange(len(values))
    for i, p in enumerate(L.PERCENTILES):
        place = np.minimum((upto < upto[:, -1:] * p - 1e-12).sum(axis=1), values.shape[1] - 1)
        out[:, i] = values[rows, order[rows, place]]
    return out


class Percentiles:
    """Reads looks of trials of one frame whose stops rise. Where the controls keep the order of the stops, which most
    trials do, percentiles stand at the same places; only the others are sorted. The display comes last, for what is
    picked alone."""

    def __init__(self, weights: np.ndarray) -> None:
        self.held = np.flatnonzero(weights > 0)
        self.weights = weights[self.held]
        upto = np.cumsum(self.weights)
        self.places = np.minimum([(upto < upto[-1] * p - 1e-12).sum() for p in L.PERCENTILES], len(upto) - 1)

    def __call__(self, logs: np.ndarray, rising: np.ndarray) -> np.ndarray:
        picked = logs[:, self.held[self.places]]
        if not rising.all():
            own = logs[np.ix_(~rising, self.held)]
            order = np.argsort(own, axis=1, kind="stable")
            upto = np.cumsum(self.weights[order], axis=1)
            at = np.stack([(upto < upto[:, -1:] * p - 1e-12).sum(axis=1) for p in L.PERCENTILES], axis=1)
            picked[~rising] = np.take_along_axis(own, np.take_along_axis(order, np.minimum(at, own.shape[1] - 1), axis=1), axis=1)
        return shown(picked)


def _in_order(stops: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(stops, kind="stable")
    return (stops[order], *(w[order] for w in weights))


def _rising(logs: np.ndarray) -> np.ndarray:
    return (logs[:, 1:] >= logs[:, :-1]).all(axis=1)


def _searched(cost: Callable[[np.ndarray], np.ndarray], prior: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The trial of least cost that moves only the free controls. Every free control is swept from the prior, as a local
    search alone stops where clipped values do not change; the best sweeps are followed by compass steps, then the best
    of these by finer ones."""
    swept = [prior]
    for c in np.flatnonzero(free):
        for v in np.linspace(-LIMIT[c], LIMIT[c], SWEEP):
            trial = prior.copy()
            trial[c] = v
            swept.append(trial)
    trials = np.array(swept)
    at = np.argsort(cost(trials), kind="stable")[:FOLLOWED]
    found, left = _compass(cost, trials[np.union1d(at, [0])], COARSE, FINE, free)
    best, _ = _compass(cost, found[[int(left.argmin())]], FINE, LAST, free)
    return best[0]


def _compass(cost: Callable[[np.ndarray], np.ndarray], starts: np.ndarray, step: float, last: float, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every start moved along single controls while that helps, each time by its best move, with steps that halve."""
    at, best = starts.copy(), cost(starts)
    moves = np.concatenate((np.diag(LIMIT)[free], -np.diag(LIMIT)[free]))
    # a start that no move of this step helped is asked again only at the next step
    going = np.arange(len(at))
    while step > last:
        trials = np.clip(at[going, None, :] + step * moves, -LIMIT, LIMIT)
        costs = cost(trials.reshape(-1, len(LIMIT))).reshape(len(going), len(moves))
        pick = costs.argmin(axis=1)
        rows = np.arange(len(going))
        better = costs[rows, pick] < best[going] - 1e-12
        moved = going[better]
        at[moved], best[moved] = trials[rows, pick][better], costs[rows, pick][better]
        going = moved
        if not len(going):
            step, going = step / 2, np.arange(len(at))
    return at, best


def _penalty(trials: np.ndarray, prior: np.ndarray) -> np.ndarray:
    return np.square((trials - prior) / LIMIT).sum(axis=1)


def solve(stops: np.ndarray, weights: np.ndarray, anchor: float, wanted: np.ndarray, prior: np.ndarray, stiffness: float = STIFFNESS, at: np.ndarray | None = None) -> np.ndarray:
    """Controls whose look comes near the wanted one; at: weights of the percentiles, 0 leaves one free."""

    stops, weights = _in_order(stops, weights)
    read = Percentiles(weights)

    def cost(trials: np.ndarray) -> np.ndarray:
        logs = shaped(stops, anchor, trials)
        off = (read(logs, _rising(logs)) - wanted) * 255
        far = np.abs(off).mean(axis=1) ** 2 if at is None else (np.square(off) * at).sum(axis=1)
        return far + stiffness * _penalty(trials, prior)

    return _searched(cost, prior, np.ones(len(LIMIT), dtype=bool))


@dataclass(frozen=True)
class Limit:
    """A bound on one figure of a look: a percentile's place, or None for the spread from the 10th to the 90th."""

    region: str | None
    place: int | None
    low: float | None
    high: float | None


def _figure(look: np.ndarray, place: int | None) -> np.ndarray:
    return look[:, L.PERCENTILES.index(0.9)] - look[:, L.PERCENTILES.index(0.1)] if place is None else look[:, place]


def violation(look: np.ndarray, regions: dict[str, np.ndarray], limits: list[Limit]) -> np.ndarray:
    """How far looks are outside of their bounds, in squared code values. Bounds on a region that is not there hold."""
    out = np.zeros(len(look))
    for b in limits:
        source = look if b.region is None else regions.get(b.region)
        if source is not None:
            x = _figure(source, b.place)
            over = np.maximum(0, x - b.high) if b.high is not None else 0.0
            under = np.maximum(0, b.low - x) if b.low is not None else 0.0
            out += np.square(over * 255) + np.square(under * 255)
    return out


def meet(stops: np.ndarray, weights: np.ndarray, anchor: float, regions: dict[str, np.ndarray], limits: list[Limit], prior: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, float]:
    """The controls nearest to the prior that keep the look within bounds, and what is left of the violation. Where the
    prior is within them, or no control is free, it comes back as it is."""

    parts = {k: w for k, w in regions.items() if (w > 0).any()}
    stops, weights, *own = _in_order(stops, weights, *parts.values())
    read, read_parts = Percentiles(weights), {k: Percentiles(w) for k, w in zip(parts, own, strict=True)}

    def off(trials: np.ndarray) -> np.ndarray:
        logs = shaped(stops, anchor, trials)
        rising = _rising(logs)
        return violation(read(logs, rising), {k: r(logs, rising) for k, r in read_parts.items()}, limits)

    before = float(off(prior[None])[0])
    if before <= MET or not free.any():
        return prior, before
    at = _searched(lambda t: off(t) + BOUND_STIFFNESS * _penalty(t, prior), prior, free)
    return at, float(off(at[None])[0])


KIND = "struct<" + ",".join(f"{c}:double" for c in L.CONTROLS) + ">"
LIMITS = "array<struct<region:string,place:int,low:double,high:double>>"
_TONE = pa.struct([(c, pa.float64()) for c in L.CONTROLS])


def _each(rows: DataFrame, columns: list[str], run: Callable[..., tuple]) -> DataFrame:
    """rows with tone and left: what run makes of a frame's columns."""
    kept = rows.schema.fields
    at = [rows.columns.index(c) for c in columns]

    def solved(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, FRAMES):
                part = batch.slice(lo, FRAMES)
                found = [run(*frame) for frame in zip(*(part.column(i).to_pylist() for i in at), strict=True)]
                tones = pa.array([dict(zip(L.CONTROLS, map(float, t), strict=True)) if t is not None else None for t, _ in found], _TONE)
                yield pa.RecordBatch.from_arrays([*part.columns, tones, pa.array([x for _, x in found], pa.float64())], names=[*(f.name for f in kept), "tone", "left"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(solved, f"{schema}, tone {KIND}, left double")


def _array(tone: dict | None) -> np.ndarray:
    return np.array([(tone or {}).get(c) or 0.0 for c in L.CONTROLS])


def solved(rows: DataFrame, *, stiffness: float = STIFFNESS) -> DataFrame:
    """rows (stops, weights, anchor, prior, wanted look, ...) with tone, the controls that come nearest to the look, and
    left, how far it still is in code values. A null prior is neutral; a frame without weight keeps its prior."""

    def run(stops, weights, anchor, prior, wanted):
        start, s, w = _array(prior), np.array(stops or [], dtype=float), np.array(weights or [], dtype=float)
        if wanted is None or anchor is None or not (w > 0).any():
            return start, None
        found = solve(s, w, anchor, np.array(wanted), start, stiffness)
        return found, float(np.abs(looks(displayed(s, anchor, found[None]), w)[0] - wanted).mean() * 255)

    return _each(rows, ["stops", "weights", "anchor", "prior", "wanted"], run)


def bounded(rows: DataFrame) -> DataFrame:
    """rows (stops, weights, anchor, prior, regions, limits, free, ...) with tone, the controls nearest to the prior that
    keep the look within its limits while only the free ones move (null: all may), and left, the violation that remains:
    above 0 where the bounds cannot be met."""

    def run(stops, weights, anchor, prior, regions, limits, free):
        start, s, w = _array(prior), np.array(stops or [], dtype=float), np.array(weights or [], dtype=float)
        if anchor is None or not limits or not (w > 0).any():
            return start, 0.0
        parts = {k: np.array(v, dtype=float) for k, v in (regions or []) if v is not None}
        named = np.array([free is None or c in free for c in L.CONTROLS])
        return meet(s, w, anchor, parts, [Limit(b["region"], b["place"], b["low"], b["high"]) for b in limits], start, named)

    return _each(rows, ["stops", "weights", "anchor", "prior", "regions", "limits", "free"], run)


@dataclass(frozen=True)
class Intent:
    """What a photographer asks for: the controls that may move, and a figure of a look that has to stay at or above
    (`low`) or at or below (`high`) a threshold. A threshold is a name, then the figure as it is counts where it is
    better already, or a factor on the figure as it is."""

    name: str
    controls: tuple[str, ...]
    place: int | None
    low: str | float | None = None
    high: str | float | None = None
    region: str | None = None
    band: bool = False


def _at(p: float) -> int:
    return L.PERCENTILES.index(p)


#: Intents by name: controls, figure, side, threshold (fixed values). A band is met anywhere between its ends.
INTENTS = (
    Intent("expose-correctly", ("exposure",), _at(0.5), low="mid_low", high="mid_high", band=True),
    Intent("preserve-highlights", ("highlights", "whites"), _at(0.99), high="highlight_cap"),
    Intent("open-shadows", ("shadows", "blacks"), _at(0.05), low="shadow_floor"),
    Intent("keep-shadows-deep", ("shadows", "blacks"), _at(0.05), high="deep_shadow_cap"),
    Intent("soft-contrast", ("contrast",), None, high=0.9),
    Intent("punchy-contrast", ("contrast",), None, low=1.1),
    Intent("save-the-sky", ("highlights", "whites"), _at(0.95), high="highlight_cap", region="sky"),
    Intent("lift-the-subject", ("shadows", "exposure"), _at(0.5), low="mid_low", region="subject"),
)


def conflicts(intents: tuple[Intent, ...] = INTENTS) -> list[tuple[str, str]]:
    """Pairs that bound one figure from opposite sides."""
    return [(a.name, b.name) for i, a in enumerate(intents) for b in intents[i + 1 :] if (a.region, a.place) == (b.region, b.place) and (a.low is None) != (b.low is None)]


def resolved(names: list[str], intents: tuple[Intent, ...] = INTENTS) -> list[Intent]:
    """The intents of these names, each once, in their own order; unknown names and conflicts raise."""
    wanted = {n.strip().lower() for n in names} - {""}
    if unknown := sorted(wanted - {i.name for i in intents}):
        raise ValueError(f"unknown intents: {unknown}")
    for a, b in conflicts(intents):
        if {a, b} <= wanted:
            raise ValueError(f"{a} and {b} ask for opposite things")
    return [i for i in intents if i.name in wanted]


def _limits(asked: list[Intent], thresholds: dict[str, float]) -> Column:
    """The bounds of the intents, given `_look` and `_looks` (by region) under the prior."""

    def one(i: Intent) -> Column:
        look = F.try_element_at("_looks", F.lit(i.region)) if i.region else F.col("_look")
        now = F.get(look, _at(0.9)) - F.get(look, _at(0.1)) if i.place is None else F.get(look, i.place)
        side = lambda t, pick: F.lit(None).cast("double") if t is None else now * t if isinstance(t, float) else F.lit(thresholds[t]) if i.band else pick(now, F.lit(thresholds[t]))
        bound = F.struct(F.lit(i.region).cast("string").alias("region"), F.lit(i.place).cast("int").alias("place"), side(i.low, F.greatest).alias("low"), side(i.high, F.least).alias("high"))
        return F.when(now.isNotNull(), bound)

    return F.array_compact(F.array(*map(one, asked))).cast(LIMITS)


def intended(frames: DataFrame, settings: str, names: list[str], thresholds: dict[str, float], *, strength: float = 1.0, intents: tuple[Intent, ...] = INTENTS) -> DataFrame:
    """frames (stops, weights, anchor, regions, settings as a map of sliders, ...) with the settings that meet the
    intents, strength of the way; left is the violation at the whole way. Only sliders that move by half a step or more
    are written, in whole steps: hundredths of a stop, units of the others."""
    asked = resolved(names, intents)
    if not asked or strength <= 0:
        return frames.withColumn("left", F.lit(0.0))
    prior = L.tone_of(F.col(settings))
    free = F.array(*[F.lit(c) for c in dict.fromkeys(c for i in asked for c in i.controls)])
    read = frames.withColumn("prior", prior).withColumn("_look", L.look_of(F.col("stops"), F.col("weights"), F.col("anchor"), F.col("prior")))
    read = read.withColumn("_looks", F.transform_values("regions", lambda _, w: L.look_of(F.col("stops"), w, F.col("anchor"), F.col("prior"))))
    found = bounded(read.withColumns({"limits": _limits(asked, thresholds), "free": free}))
    changed = []
    for c, (name, unit) in L.SLIDERS.items():
        was = F.col("prior")[c] * unit
        to = was + (F.col("tone")[c] * unit - was) * strength
        steps = 100.0 if c == "exposure" else 1.0
        changed.append(F.struct(F.lit(name).alias("key"), F.when(F.abs(to - was) * steps >= 0.5, F.floor(to * steps + 0.5) / steps).alias("value")))
    moves = F.map_from_entries(F.filter(F.array(*changed), lambda e: e["value"].isNotNull()))
    kept = F.map_filter(settings, lambda k, _: ~F.array_contains(F.map_keys(moves), k))
    return found.withColumn(settings, F.map_concat(kept, moves)).drop("prior", "_look", "_looks", "limits", "free", "tone")
