"""Two heads that foretell edits: the level of a session from its mean vector, and what a frame does beside it from its
deviation; gates for what held-out sessions do not support, and the predictor.

Training takes five passes over the frames: session means, moments of both heads by fold of sessions, their errors,
moments by fold of single frames, and the errors of both heads together under either. All targets are in the space
in which edits add up; what encodes and decodes them stands before and after.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.jsmath import clamp, round_half_up
from . import evaluate, folds, moments, sessions

SCHEMA = 1
#: Below this spread a target does not vary, and its heads stay constant.
DEGENERATE = 1e-9
#: Renderings that a profile may tell apart.
MAX_RENDERS = 256


@dataclass(frozen=True)
class Brakes:
    """How careful a profile is: the bar that a skill has to clear, in spreads of that skill and at least; how far a
    response may stretch; how much error the frame head may pay for its reach."""

    gate_spreads: float
    gate_floor: float
    max_response: float
    frame_allowance: float


#: From careful to bold (fixed values).
CAREFUL, BOLD = Brakes(1.0, 0.02, 3.0, 0.05), Brakes(0.0, 0.0, 8.0, 0.3)


def brakes(boldness: float) -> Brakes:
    """A mix of the two ends, boldness 0 to 1."""
    b = min(max(boldness, 0.0), 1.0)
    mixed = lambda name: (1 - b) * getattr(CAREFUL, name) + b * getattr(BOLD, name)
    return Brakes(*map(mixed, Brakes.__dataclass_fields__))


@dataclass
class Head:
    """Linear answers by target. A gated target answers with its constant."""

    weights: np.ndarray
    intercept: np.ndarray
    constant: np.ndarray
    response: np.ndarray
    gated: np.ndarray
    penalty: np.ndarray
    skill: np.ndarray
    spread: np.ndarray
    shipped: np.ndarray

    def linear(self) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients, intercepts) of what it gives out: stretched about its constant, or that constant."""
        scale = np.where(self.gated, 0.0, self.response)
        return self.weights * scale, self.constant + scale * (self.intercept - self.constant)


@dataclass
class Profile:
    """What the trainer hands to the predictor."""

    params: list[str]
    level: Head
    frame: Head
    renders: list[str] = field(default_factory=list)
    default_render: str | None = None
    skill: np.ndarray | None = None
    skill_random: np.ndarray | None = None
    mae: np.ndarray | None = None
    baseline: np.ndarray | None = None
    offsets: dict[str, float] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    guards: dict[str, object] = field(default_factory=dict)
    reasons: dict[str, str] = field(default_factory=dict)

    def rows(self) -> list[dict]:
        """A row per parameter and head."""
        out = []
        for name, head in (("level", self.level), ("frame", self.frame)):
            b, c = head.linear()
            for t, p in enumerate(self.params):
                whole = {k: None if v is None else float(v[t]) for k, v in (("end_skill", self.skill), ("end_skill_random", self.skill_random))}
                out.append({"param": p, "head": name, "penalty": float(head.penalty[t]), "skill": float(head.skill[t]), "spread": float(head.spread[t]), "response": float(head.response[t]), "shipped": float(head.shipped[t]), "gated": bool(head.gated[t]), "reason": self.reasons.get(p) if head.gated[t] else None, **whole, "weights": b[:, t].tolist(), "intercept": float(c[t])})
        return out


ROWS = "param string, head string, penalty double, skill double, spread double, response double, shipped double, gated boolean, reason string, end_skill double, end_skill_random double, weights array<double>, intercept double"


def views(frames: DataFrame, session: str, x: str, y: str, renders: list[str], render: str | None, source: DataFrame | None = None) -> DataFrame:
    """frames with _level, the session's mean of x and the rendering as one-hot; _frame, x less that mean; _yl and _yf,
    the session's mean of y and the rest; _truth, y."""
    both = lambda df: df.withColumn("_z", F.concat(x, y))
    joined = sessions.with_context(both(frames), session, "_z", source=both(frames if source is None else source))
    mean = lambda at, n: F.slice("context", at, n)
    shown = arrays.one_hot(F.col(render), renders) if render and renders else F.array().cast("array<double>")
    level = mean(F.lit(1), F.size(x))
    y_level = mean(F.size(x) + 1, F.size(y))
    return joined.withColumns({"_level": F.concat(level, shown), "_frame": arrays.deviation(F.col(x), level), "_yl": y_level, "_yf": arrays.deviation(F.col(y), y_level), "_truth": F.col(y).cast("array<double>")}).drop("_z", "context")


def _fitted(plan: evaluate.Plan, found: evaluate.Judged, b: Brakes, spread: np.ndarray) -> Head:
    """A head from all rows at each target's penalty, not yet gated but for targets that do not vary."""
    weights, intercept = np.zeros((plan.everything.dim, plan.targets)), np.zeros(plan.targets)
    for p in set(found.penalty.tolist()):
        at = found.penalty == p
        w, c = plan.fit(plan.everything, p)
        weights[:, at], intercept[at] = w[:, at], c[at]
    constant = plan.everything.mean[plan.everything.dim :]
    return Head(weights, intercept, constant, found.response.copy(), spread < DEGENERATE, found.penalty, found.skill, found.spread, found.shipped.copy())


def _renders(frames: DataFrame, render: str, least: int) -> tuple[list[str], str | None]:
    """The values of at least so many frames, each of which is a column of the level head, and the most frequent value."""
    counts = frames.filter(F.col(render).isNotNull()).groupBy(F.col(render).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    usual = counts.orderBy(F.col("_n").desc(), "_r").first()
    told = [r["_r"] for r in counts.filter(F.col("_n") >= least).limit(MAX_RENDERS + 1).collect()]
    if len(told) > MAX_RENDERS:
        raise ValueError(f"more than {MAX_RENDERS} renderings have {least} frames, and each is a column: raise min_renders")
    return sorted(told), usual["_r"] if usual else None


def train(frames: DataFrame, session: str, x: str, y: str, params: list[str], *, k: int = 5, boldness: float = 0.0, render: str | None = None, min_renders: int = 3, key: str = "file", masks: tuple[np.ndarray, np.ndarray] | None = None, guards: dict | None = None) -> Profile:
    """frames (file, session, x, y, ...): a profile. masks: for either head, which of its columns each target may
    read. render: a column whose values of at least min_renders frames are told apart by the level head, at most
    MAX_RENDERS of them (more raise)."""
    careful = brakes(boldness)
    renders, usual = _renders(frames, render, min_renders) if render else ([], None)
    # rows are numbered while they are narrow; what can be made from the two views again is not held
    frames = frames.select(*dict.fromkeys(c for c in (key, "file", session, x, y, render) if c in frames.columns))
    narrow = folds.round_robin(frames, key, k).withColumnRenamed("fold", "_by_frame")
    held = folds.dealt(views(narrow, session, x, y, renders, render, frames), session, k, frames).select("fold", "_by_frame", "_level", "_frame", "_yl", "_yf", "_truth").persist()
    seen = held.withColumns({"_x": F.concat("_level", "_frame"), "_y": F.concat("_yl", "_yf")})
    parts = moments.collect(seen, "_x", "_y", "fold")
    whole, p = moments.total(parts), len(params)
    d_level = whole.dim - len(frames.select(x).limit(1).collect()[0][0])
    picks = {"level": (slice(0, d_level), slice(0, p)), "frame": (slice(d_level, None), slice(p, None))}
    spread = np.sqrt(np.maximum(np.diag(whole.covariance)[whole.dim :], 0) / max(whole.weight, 1.0))
    plans, heads = {}, {}
    for i, (name, (at_x, at_y)) in enumerate(picks.items()):
        plans[name] = evaluate.Plan({g: m.picked(at_x, at_y) for g, m in parts.items()}, most=careful.max_response, masks=masks[i] if masks else None)
    # the frame head is judged on the session's own level, so both heads' truths are what each of them has to meet
    for name, columns in (("level", ("_level", "_truth")), ("frame", ("_frame", "_yf"))):
        errors = moments.errors(seen, *columns, plans[name].models(), "fold")
        heads[name] = _fitted(plans[name], plans[name].judged(errors), careful, spread[:p] if name == "level" else spread[p:])
    level, frame = heads["level"], heads["frame"]
    bar = lambda h: np.maximum(careful.gate_floor, careful.gate_spreads * h.spread)
    never = careful.gate_spreads <= 0 and careful.gate_floor <= 0
    reasons = {q: "degenerate" for q, g in zip(params, level.gated & frame.gated, strict=True) if g}
    level.gated |= ~np.full(p, never) & (np.minimum(level.skill, level.shipped) <= bar(level))
    frame.gated |= ~np.full(p, never) & ((frame.skill <= bar(frame)) | (frame.shipped < -careful.frame_allowance))
    profile = Profile(params, level, frame, renders, usual, guards={"schema": SCHEMA, **(guards or {})}, reasons=reasons)
    profile.skill, profile.mae, profile.baseline = _together(seen, parts, "fold", profile, plans, d_level)
    random = moments.collect(seen, "_x", "_y", "_by_frame")
    profile.skill_random = _together(seen, random, "_by_frame", profile, plans, d_level)[0]
    # whatever the bar: what is worse than the constant does not go out
    worse = (profile.skill < 0) & ~(level.gated & frame.gated)
    level.gated |= worse
    frame.gated |= worse
    profile.skill, profile.mae = np.where(worse, 0.0, profile.skill), np.where(worse, profile.baseline, profile.mae)
    profile.skill_random = np.where(worse, 0.0, profile.skill_random)
    for t, q in enumerate(params):
        reasons.setdefault(q, "worse than the constant" if worse[t] else "below the bar")
    held.unpersist()
    for h in (level, frame):
        h.response = np.where(h.gated, 1.0, h.response)
        h.shipped = np.where(h.gated, 0.0, h.shipped)
    return profile


#: Frames that a branch needs, and for each fold of an evaluation; the penalty of a branch that is not evaluated (fixed
#: values).
LEAST_FRAMES, LEAST_BRANCH, FRAMES_PER_FOLD, PLAIN_PENALTY = 2, 5, 4, 1.0


def plain(frames: DataFrame, session: str, x: str, y: str, params: list[str], *, render: str | None = None, min_renders: int = 3, guards: dict | None = None, penalty: float = PLAIN_PENALTY) -> Profile:
    """A profile of too few frames to hold any out: both heads at one penalty, no skills, nothing gated but targets that
    do not vary."""
    renders, usual = _renders(frames, render, min_renders) if render else ([], None)
    seen = views(frames, session, x, y, renders, render).select(F.lit("all").alias("g"), F.concat("_level", "_frame").alias("_x"), F.concat("_yl", "_yf").alias("_y"), F.size("_level").alias("_d"))
    whole, p = moments.total(moments.collect(seen, "_x", "_y", "g")), len(params)
    d_level = seen.select("_d").first()["_d"]
    heads = []
    for at_x, at_y in ((slice(0, d_level), slice(0, p)), (slice(d_level, None), slice(p, None))):
        m = whole.picked(at_x, at_y)
        weights, intercept = moments.ridge(m, penalty, per_weight=True, standardised=True)
        spread = np.sqrt(np.maximum(np.diag(m.covariance)[m.dim :], 0) / max(m.weight, 1.0))
        none = np.full(p, np.nan)
        heads.append(Head(weights, intercept, m.mean[m.dim :], np.ones(p), spread < DEGENERATE, np.full(p, penalty), none, none, none))
    reasons = {q: "degenerate" for q, g in zip(params, heads[0].gated & heads[1].gated, strict=True) if g}
    return Profile(params, *heads, renders, usual, guards={"schema": SCHEMA, **(guards or {})}, reasons=reasons)


@dataclass
class Branched:
    """A profile for each treatment of enough frames; what was left out, and what was trained but not evaluated, with the
    reason."""

    branches: dict[str, Profile]
    left_out: dict[str, str]
    unevaluated: dict[str, str]


def train_dataset(frames: DataFrame, treatment: str, session: str, x: str, y: str, params: list[str], *, k: int = 5, **options) -> Branched:
    """A profile per treatment (null counts as none). A dataset of fewer than LEAST_FRAMES frames, or without a branch of
    LEAST_BRANCH, raises; a branch is evaluated from FRAMES_PER_FOLD * k frames on, and else fitted plainly."""
    counts = {r["t"]: r["n"] for r in frames.groupBy(F.col(treatment).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(counts.values()) < LEAST_FRAMES:
        raise ValueError(f"{sum(counts.values())} edited frames are too few")
    out = Branched({}, {}, {})
    for name, n in sorted((str(t), n) for t, n in counts.items() if t is not None):
        if n < LEAST_BRANCH:
            out.left_out[name] = f"{n} frames, of {LEAST_BRANCH} that a branch needs"
            continue
        own = frames.filter(F.col(treatment) == name)
        if n < FRAMES_PER_FOLD * k:
            out.unevaluated[name] = f"{n} frames, of {FRAMES_PER_FOLD * k} that {k} folds need"
            out.branches[name] = plain(own, session, x, y, params, **{o: v for o, v in options.items() if o in ("render", "min_renders", "guards")})
        else:
            out.branches[name] = train(own, session, x, y, params, k=k, **options)
    if not out.branches:
        raise ValueError(f"no treatment has enough edited frames: {out.left_out}")
    return out


def _together(seen: DataFrame, parts: dict[str, moments.Moments], group: str, profile: Profile, plans: dict[str, evaluate.Plan], d_level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(skill, mae, baseline) of both heads added up as they go out, each fold by heads that have not seen it, against
    the mean edit."""
    whole, p = moments.total(parts), len(profile.params)
    models = {}
    for g, part in parts.items():
        m = whole - part
        mean = m.mean[m.dim :]
        b, c = np.zeros((m.dim, p)), np.zeros(p)
        for (name, head), at_x, at_y in zip((("level", profile.level), ("frame", profile.frame)), (slice(0, d_level), slice(d_level, None)), (slice(0, p), slice(p, None)), strict=True):
            own, constant = m.picked(at_x, at_y), mean[at_y]
            for penalty in set(head.penalty.tolist()):
                at = head.penalty == penalty
                w, i = plans[name].fit(own, penalty)
                scale = np.where(head.gated, 0.0, head.response)
                b[at_x][:, at] += (w * scale)[:, at]
                c[at] += (constant + scale * (i - constant))[at]
        models[g] = (np.concatenate((np.zeros((m.dim, p)), b), axis=1), np.concatenate((mean[:p] + mean[p:], c)))
    found = moments.errors(seen, "_x", "_truth", models, group)
    n = sum(k for k, _ in found.values())
    baseline, mae = (sum(e for _, e in found.values()) / n).reshape(2, p)
    return evaluate.skill(mae, baseline), mae, baseline


class NotApplicable(ValueError):
    """A profile and a dataset that do not belong together."""


def assert_applicable(profile: Profile, facts: dict[str, object]) -> None:
    """Raises unless the dataset states what the profile was trained on: each guard by name."""
    for name, value in profile.guards.items():
        if name not in facts or facts[name] is None:
            raise NotApplicable(f"the dataset does not say its {name}; the profile's is {value!r}")
        if facts[name] != value:
            raise NotApplicable(f"the profile's {name} is {value!r}, the dataset's {facts[name]!r}")


def branch(profiles: dict[str, Profile], wanted: str | None, order: tuple[str, ...] = ("color", "bw")) -> str:
    """The branch to apply: the wanted one, else the first of the order that the profiles have."""
    if wanted in profiles:
        return wanted
    for name in order:
        if name in profiles:
            return name
    raise NotApplicable("the profile has no trained branch")


def _answer(head: Head, x: Column, t: int) -> Column:
    b, c = head.linear()
    if not np.any(b[:, t]):
        return F.lit(float(c[t]))
    return arrays.dot(x, F.array(*[F.lit(float(v)) for v in b[:, t]])) + float(c[t])


def predicted(frames: DataFrame, profile: Profile, session: str, x: str, *, facts: dict[str, object], render: str | None = None, override: str | None = None, anchors: dict[str, Column] | None = None) -> DataFrame:
    """frames with a column for each parameter: level and frame head added up, an anchor's value in their stead where it
    is not null, the calibration offset, the parameter's bounds, four digits. A rendering that the profile does not
    know counts as its default; override wins over both."""
    assert_applicable(profile, facts)
    known = F.when(F.col(render).isin(*profile.renders), F.col(render)).otherwise(F.lit(profile.default_render)) if render else F.lit(profile.default_render)
    shown = arrays.one_hot(F.lit(override) if override else known, profile.renders) if profile.renders else F.array().cast("array<double>")
    joined = sessions.with_context(frames, session, x)
    level, own = F.concat(F.col("context"), shown), arrays.deviation(F.col(x), F.col("context"))
    out = {}
    for t, name in enumerate(profile.params):
        value = _answer(profile.level, level, t) + _answer(profile.frame, own, t)
        if anchors and name in anchors:
            value = F.coalesce(anchors[name], value)
        value = value + profile.offsets.get(name, 0.0)
        if name in profile.bounds:
            value = clamp(value, *profile.bounds[name])
        out[name] = round_half_up(value, 4)
    return joined.withColumns(out).drop("context")
