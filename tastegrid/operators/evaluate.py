"""Held-out evaluation of linear heads: penalties, slopes that undo shrinkage, nested skill.

Every fit comes from the moments of the folds, and so do the slopes, which are quadratic in them; absolute errors need
the rows once more. A head is therefore judged in two passes: one collects moments, one sums the errors of all its
models together: each fold's under every penalty, plain and stretched, and those that leave out a second fold, for the
choice of the penalty within a fold's training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from . import folds, moments

#: Penalties tried, on columns over their spreads, and what the total weight is counted with (fixed values).
PENALTIES = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0)
TIE = 1e-6
LEAST_MAE = 1e-6
#: How far a slope may stretch a head's answer.
MAX_RESPONSE = 3.0


def with_folds(df: DataFrame, session: str, k: int) -> DataFrame:
    """df with fold; whole sessions are held out."""
    return folds.dealt(df, session, k)


def chosen(skills: dict[float, float]) -> float:
    """The penalty of the best skill; of those as good, the largest."""
    best = max(skills.values())
    return max(p for p, s in skills.items() if s >= best - TIE)


def response(slope: float, most: float = MAX_RESPONSE) -> float:
    """A slope within [0, most]; one that is not a number is 1."""
    return float(np.clip(slope, 0, most)) if np.isfinite(slope) else 1.0


def skill(mae: np.ndarray, baseline: np.ndarray) -> np.ndarray:
    return np.where(baseline > LEAST_MAE, 1 - mae / np.maximum(baseline, LEAST_MAE), 0.0)


@dataclass
class Judged:
    """A head's evidence, an array over targets each; table has a row per penalty."""

    penalty: np.ndarray
    skill: np.ndarray  # nested: no fold chose its own penalty
    spread: np.ndarray  # of that skill over the folds
    response: np.ndarray
    shipped: np.ndarray  # at the chosen penalty, stretched by the response
    mae: np.ndarray
    baseline: np.ndarray
    table: list[dict]


class Plan:
    """The models of a head by fold, for the pass that sums their errors."""

    def __init__(self, parts: dict[str, moments.Moments], penalties=PENALTIES, most: float = MAX_RESPONSE, masks: np.ndarray | None = None) -> None:
        self.parts, self.penalties, self.masks = parts, penalties, masks
        self.everything = moments.total(parts)
        self.folds = sorted(parts)
        self.targets = len(self.everything.centre) - self.everything.dim
        self.fits = {g: [self.fit(self.everything - parts[g], p) for p in penalties] for g in self.folds}
        self.slopes = self._slopes(self.folds, self.fits, lambda g: self.everything - parts[g], most)
        # within the training rows of fold f, the other folds take turns
        self.inner, self.inner_slopes = {}, {}
        if len(self.folds) > 2:
            for f in self.folds:
                rest = [g for g in self.folds if g != f]
                self.inner[f] = {g: [self.fit(self.everything - parts[f] - parts[g], p) for p in penalties] for g in rest}
                self.inner_slopes[f] = self._slopes(rest, self.inner[f], lambda g, f=f: self.everything - parts[f] - parts[g], most)

    def fit(self, m: moments.Moments, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and intercepts; targets that share a mask share a solution."""
        if self.masks is None:
            return moments.ridge(m, penalty, per_weight=True, standardised=True)
        b, c = np.zeros((m.dim, self.targets)), np.zeros(self.targets)
        for mask in np.unique(self.masks, axis=0):
            at = np.flatnonzero((self.masks == mask).all(axis=1))
            found = moments.ridge(m, penalty, per_weight=True, standardised=True, allowed=mask)
            b[:, at], c[at] = found[0][:, at], found[1][at]
        return b, c

    def _slopes(self, some, fits, train, most) -> np.ndarray:
        """(penalty, target): the slope of truth on prediction over the folds in some, each about its own constant."""
        out = np.ones((len(self.penalties), self.targets))
        for k in range(len(self.penalties)):
            n, sp, sy, spp, spy = 0.0, *np.zeros((4, self.targets))
            for g in some:
                (b, c), part, mean = fits[g][k], self.parts[g], train(g).mean[self.everything.dim :]
                w, x, y = part.weight, part.mean[: part.dim], part.mean[part.dim :]
                at, to = x @ b + c - mean, y - mean
                s = part.covariance
                n += w
                sp, sy = sp + w * at, sy + w * to
                spp = spp + np.einsum("ij,ik,kj->j", b, s[: part.dim, : part.dim], b) + w * at * at
                spy = spy + np.einsum("ij,ij->j", b, s[: part.dim, part.dim :]) + w * at * to
            varied, along = spp / n - (sp / n) ** 2, spy / n - (sp / n) * (sy / n)
            out[k] = [response(a / v, most) if v > TIE**2 else 0.0 for a, v in zip(along, varied, strict=True)]
        return out

    @staticmethod
    def stretched(fit, mean: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A fit whose answers go slope times as far from mean."""
        b, c = fit
        return b * slope, mean + slope * (c - mean)

    def models(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """fold -> the models that are scored on it: the constant, each penalty plain and stretched, then those without
        a second fold, stretched."""
        out, d = {}, self.everything.dim
        for g in self.folds:
            mean = (self.everything - self.parts[g]).mean[d:]
            found = [(np.zeros((d, self.targets)), mean), *self.fits[g], *(self.stretched(m, mean, self.slopes[k]) for k, m in enumerate(self.fits[g]))]
            for f in self.folds:
                if f in self.inner and f != g:
                    inside = (self.everything - self.parts[f] - self.parts[g]).mean[d:]
                    found += [self.stretched(m, inside, self.inner_slopes[f][k]) for k, m in enumerate(self.inner[f][g])]
                    found.append((np.zeros((d, self.targets)), inside))
            out[g] = (np.concatenate([b for b, _ in found], axis=1), np.concatenate([c for _, c in found]))
        return out

    def judged(self, errors: dict[str, tuple[int, np.ndarray]]) -> Judged:
        """errors: what moments.errors gives for models()."""
        n, p = sum(k for k, _ in errors.values()), len(self.penalties)
        by = {g: errors[g][1].reshape(-1, self.targets) for g in self.folds}
        whole = sum(by[g][: 1 + 2 * p] for g in self.folds) / n
        baseline, plain, shipped = whole[0], whole[1 : 1 + p], whole[1 + p :]
        told = skill(shipped, baseline)
        pick = np.array([self.penalties.index(chosen(dict(zip(self.penalties, told[:, t].tolist(), strict=True)))) for t in range(self.targets)])
        own = np.zeros((len(self.folds), self.targets), dtype=int)
        for i, f in enumerate(self.folds):
            own[i] = p - 1
            if f in self.inner:
                places = {g: 1 + 2 * p + (p + 1) * [x for x in self.folds if x != g].index(f) for g in self.folds if g != f}
                inner = sum(by[g][at : at + p] for g, at in places.items())
                against = sum(by[g][at + p] for g, at in places.items())
                found = skill(inner, against)
                own[i] = [self.penalties.index(chosen(dict(zip(self.penalties, found[:, t].tolist(), strict=True)))) for t in range(self.targets)]
        t = np.arange(self.targets)
        held = np.array([by[f][1 + own[i], t] for i, f in enumerate(self.folds)])
        base = np.array([by[f][0] for f in self.folds])
        each = np.where(base > LEAST_MAE, 1 - held / np.maximum(base, LEAST_MAE), np.nan)
        table = [
            {"penalty": float(x), "target": int(j), "mae": float(plain[k, j]), "baseline": float(baseline[j]), "skill": float(skill(plain[k], baseline)[j]), "response": float(self.slopes[k, j]), "shipped": float(told[k, j])}
            for k, x in enumerate(self.penalties) for j in range(self.targets)
        ]
        spread = np.array([np.nanstd(v) if np.isfinite(v).sum() > 1 else 0.0 for v in each.T])
        return Judged(np.array(self.penalties)[pick], skill(held.sum(axis=0), base.sum(axis=0)), spread, self.slopes[pick, t], told[pick, t], plain[pick, t], baseline, table)


def judged(df: DataFrame, x: str, y: str, penalties=PENALTIES, weight: str | None = None) -> Judged:
    """df (fold, x, y): the evidence for a linear head from x to y, by fold."""
    plan = Plan(moments.collect(df, x, y, "fold", weight), penalties)
    return plan.judged(moments.errors(df, x, y, plan.models(), "fold"))


def skills(df: DataFrame, x: str, y: str, penalties=PENALTIES, weight: str | None = None) -> DataFrame:
    """A row per penalty and target: mae, baseline, skill, the slope that undoes shrinkage and the skill with it."""
    return df.sparkSession.createDataFrame(judged(df, x, y, penalties, weight).table, "penalty double, target int, mae double, baseline double, skill double, response double, shipped double")


def held_out_deltas(df: DataFrame, key: str, x: str, y: str, penalties: float | list[float], *, responses: list[float] | None = None, weight: str | None = None) -> DataFrame:
    """df (key, fold, x, y): a row per frame with what a model of the other folds says of it: predicted, truth, and
    constant, the other folds' mean. Penalties are fixed, one for all targets or one each; responses stretch the answers
    about that mean. One pass collects moments, one scores. A fold whose others have fewer than two rows gets zeros, as
    there is nothing to fit."""
    parts = moments.collect(df, x, y, "fold", weight)
    schema = StructType([df.schema[key], df.schema["fold"], *(StructField(n, ArrayType(DoubleType())) for n in ("predicted", "truth", "constant"))])
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    whole = moments.total(parts)
    d, t = whole.dim, len(whole.centre) - whole.dim
    each = np.broadcast_to(np.array(penalties, dtype=float), (t,))
    models = {}
    for g, part in parts.items():
        rest = whole - part
        b, c, mean = np.zeros((d, t)), np.zeros(t), np.zeros(t)
        if rest.n >= 2:
            mean = rest.mean[d:]
            for p in np.unique(each):
                at = each == p
                w, i = moments.ridge(rest, float(p), per_weight=True, standardised=True)
                b[:, at], c[at] = w[:, at], i[at]
            if responses is not None:
                b, c = Plan.stretched((b, c), mean, np.array(responses, dtype=float))
        models[g] = b, c, mean
    shared = df.sparkSession.sparkContext.broadcast(models)

    def lists(rows: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * t, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))

    def scored(batches):
        for batch in batches:
            fold = batch.column(1).cast(pa.string()).dictionary_encode()
            z, truth, place = moments.matrix(batch.column(2), d), moments.matrix(batch.column(3), t), np.asarray(fold.indices)
            said, constant = np.empty((len(z), t)), np.empty((len(z), t))
            for i, g in enumerate(fold.dictionary.to_pylist()):
                b, c, mean = shared.value[g]
                at = place == i
                said[at], constant[at] = z[at] @ b + c, mean
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(said), lists(truth), lists(constant)], names=schema.names)

    return df.select(key, "fold", F.col(x).cast("array<double>"), F.col(y).cast("array<double>")).mapInArrow(scored, schema)


def by_group(df: DataFrame, x: str, y: str, group: str, penalties=PENALTIES) -> DataFrame:
    """df (fold, group, x, y): the best skill by target of one model over all rows, and of a model each group, from one
    pass of moments by group and fold and one of errors. Groups are few, as each has a model."""
    both = df.withColumn("_key", F.concat_ws("\u0001", group, "fold"))
    parts = moments.collect(both, x, y, "_key")
    groups = sorted({key.split("\u0001")[0] for key in parts})
    folds_ = sorted({key.split("\u0001")[1] for key in parts})
    pooled = Plan({f: moments.total({k: m for k, m in parts.items() if k.split("\u0001")[1] == f}) for f in folds_}, penalties)
    own = {g: Plan({k.split("\u0001")[1]: m for k, m in parts.items() if k.split("\u0001")[0] == g}, penalties) for g in groups}
    cut = {f: m for f, m in pooled.models().items()}
    mine = {g: p.models() for g, p in own.items()}
    models = {k: tuple(np.concatenate((cut[f][i], mine[g][f][i]), axis=-1) for i in (0, 1)) for k in parts for g, f in [k.split("\u0001")]}
    found = moments.errors(both, x, y, models, "_key")
    width = {f: cut[f][1].size for f in folds_}
    pooled_errors = {f: (sum(found[k][0] for k in found if k.split("\u0001")[1] == f), sum(found[k][1][: width[f]] for k in found if k.split("\u0001")[1] == f)) for f in folds_}
    rows = [("pooled", t, float(s)) for t, s in enumerate(pooled.judged(pooled_errors).skill)]
    for g in groups:
        errors = {k.split("\u0001")[1]: (found[k][0], found[k][1][width[k.split("\u0001")[1]] :]) for k in found if k.split("\u0001")[0] == g}
        rows += [(g, t, float(s)) for t, s in enumerate(own[g].judged(errors).skill)]
    return df.sparkSession.createDataFrame(rows, "model string, target int, skill double")
