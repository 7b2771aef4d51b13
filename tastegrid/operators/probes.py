"""What a shoot's own frames tell beside a model of all shoots, and what frames of one treatment tell of another."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import fresh
from . import folds, moments
from .evaluate import PENALTIES

#: Estimators of a frame's value when some frames of its shoot are known.
METHODS = ("constant", "model", "shoot mean", "model + offset", "model + shrunk offset")
#: Frames that have to be left to be foretold; the least variance between shoots.
LEAST_LEFT, LEAST_BETWEEN = 2, 1e-9
#: Numbers of all means that are broadcast; copies of a mean for a join beyond that.
BROADCAST_NUMBERS, SALT = 8 << 20, 8


def kappas(frames: DataFrame) -> list[float]:
    """frames (session, residual array): for each target how many frames of a shoot outweigh the model, the variance
    within shoots over that between them, by moments over shoots of more than one frame."""
    cells = frames.select("session", F.posexplode("residual").alias("t", "r"))
    by = cells.groupBy("session", "t").agg(F.count("r").alias("n"), F.avg("r").alias("m"), (F.var_pop("r") * F.count("r")).alias("within"), F.sum("r").alias("s")).filter("n > 1")
    whole = by.groupBy("t").agg((F.sum("within") / F.sum("n")).alias("within"), (F.sum("s") / F.sum("n")).alias("grand"), F.avg("n").alias("n"))
    spread = by.join(F.broadcast(whole.select("t", F.col("grand"))), "t").groupBy("t").agg(F.avg((F.col("m") - F.col("grand")) ** 2).alias("means"))
    rows = whole.join(spread, "t").select("t", (F.col("within") / F.greatest(F.lit(LEAST_BETWEEN), F.col("means") - F.col("within") / F.col("n"))).alias("k"))
    return [r["k"] for r in rows.orderBy("t").collect()]


def calibration_curve(frames: DataFrame, key: str, session: str, predicted: str, truth: str, constant: str, ks: tuple[int, ...] = (0, 1, 2, 4, 8)) -> DataFrame:
    """frames (key, session, and arrays over targets: what a model of other shoots says, the truth, and the constant of
    other shoots): a row per k, target and method, with the frames foretold, n, and their mean absolute error, when the
    first k frames of each shoot, by hash, are known. Shoots with fewer than LEAST_LEFT frames beyond k say nothing at
    that k; without known frames there are only the constant and the model.

    Of a shoot only its first max(ks) frames are gathered, by a limit that each task applies before anything is
    shuffled."""
    own = frames.select(F.col(session).alias("session"), F.struct(F.md5(F.col(key).cast("string")).alias("h"), F.col(key).alias("k")).alias("o"), F.col(predicted).alias("p"), F.col(truth).alias("y"), F.col(constant).alias("c"))
    shrink = kappas(own.select("session", F.zip_with("y", "p", lambda y, p: y - p).alias("residual")))
    place = F.row_number().over(Window.partitionBy("session").orderBy("o"))
    first = own.withColumn("place", place).filter(F.col("place") <= max(ks)).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("place", "o", "p", "y"))).alias("first"))
    sizes = own.groupBy("session").agg(F.count(F.lit(1)).alias("n")).join(first, "session", "left")
    rows = own.join(sizes, "session").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    rest = rows.filter((F.col("n") >= F.col("k") + LEAST_LEFT) & ((F.col("k") == 0) | (F.col("o") > F.get("first", F.col("k") - 1)["o"])))
    seen = F.slice("first", F.lit(1), F.col("k"))
    cells = rest.select("k", F.posexplode("y").alias("t", "y"), "p", "c", seen.alias("seen"))
    mean = lambda value: F.aggregate(F.transform("seen", value), F.lit(0.0), lambda a, v: a + v) / F.col("k")
    at = lambda c: F.get(c, F.col("t"))
    kappa = F.array(*[F.lit(float(v)) for v in shrink]) if shrink else F.array().cast("array<double>")
    known = cells.select("k", "t", "y", at("p").alias("p"), at("c").alias("c"), F.when(F.col("k") > 0, mean(lambda s: F.get(s["y"], F.col("t")) - F.get(s["p"], F.col("t")))).alias("off"), F.when(F.col("k") > 0, mean(lambda s: F.get(s["y"], F.col("t")))).alias("mean"), (F.col("k") / (F.col("k") + at(kappa))).alias("share"))
    said: dict[str, Column] = dict(zip(METHODS, (F.col("c"), F.col("p"), F.col("mean"), F.col("p") + F.col("off"), F.col("p") + F.col("share") * F.col("off")), strict=True))
    off = known.groupBy("k", "t").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.abs(v - F.col("y"))).alias(m) for m, v in said.items()])
    long = off.select("k", F.col("t").alias("target"), "n", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"`{m}`").alias("mae")) for m in METHODS])).alias("x"))
    return long.select("k", "target", "n", "x.method", "x.mae").filter("mae IS NOT NULL")


def deviations(frames: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """frames with array columns less their means over the group: averages by place in all columns at once, broadcast
    while their numbers are few (counted), else joined on the group and a salt, so that no task holds all rows of one."""
    *marks, salt, own = fresh(frames, *[f"_g{i}" for i in range(len(group))], "_salt", "_own")
    means = fresh(frames, *[f"_mean{i}" for i in range(len(columns))])
    told = frames.agg(*[F.coalesce(F.max(F.size(c)), F.lit(0)) for c in columns], F.count_distinct(F.struct(*group))).first()
    widths, groups = [max(w, 0) for w in told[:-1]], told[-1]
    sums = frames.groupBy(*[F.col(g).alias(m) for g, m in zip(group, marks, strict=True)]).agg(
        *[F.max(F.size(c)).alias(f"_n{i}") for i, c in enumerate(columns)],
        *[F.avg(F.get(c, j)).alias(f"_m{i}_{j}") for i, (c, w) in enumerate(zip(columns, widths, strict=True)) for j in range(w)],
    )
    mean = lambda i: F.slice(F.array(*[F.col(f"_m{i}_{j}") for j in range(widths[i])]).cast("array<double>"), F.lit(1), F.col(f"_n{i}"))
    known = sums.filter(" AND ".join(f"_n{i} > 0" for i in range(len(columns)))).select(*marks, *[mean(i).alias(m) for i, m in enumerate(means)])
    same = F.lit(True)
    for g, m in zip(group, marks, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(m))
    if groups * max(sum(widths), 1) <= BROADCAST_NUMBERS:
        joined = frames.join(F.broadcast(known), same)
    else:
        copies = known.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
        salted = frames.withColumn(own, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in frames.columns]), F.lit(SALT)))
        joined = salted.join(copies, same & (F.col(own) == F.col(salt)))
    return joined.withColumns({c: F.zip_with(c, m, lambda a, b: a - b) for c, m in zip(columns, means, strict=True)}).drop(*marks, *means, salt, own)


def treatment_transfer(frames: DataFrame, treatment: str, session: str, x: str, y: str, *, k: int = 5, penalties: tuple[float, ...] = PENALTIES) -> list[tuple[str, str, int, float, float]]:
    """(trained on, tried on, target, mae, skill): how well a head for what a frame does beside its shoot, fitted on one
    treatment or on all ("pooled"), foretells frames of each treatment in shoots that it has not seen. Features and
    targets are deviations from the mean of treatment and shoot; skill is against no deviation at all. The penalty of a
    fold is the one of least absolute error among the other folds of what is trained on."""
    kept = frames.filter(F.col(treatment).isNotNull()).select(F.col(treatment).cast("string").alias("_t"), F.col(session).alias("_s"), F.col(x).cast("array<double>").alias("_x"), F.col(y).cast("array<double>").alias("_y"))
    first = kept.filter("_x IS NOT NULL AND _y IS NOT NULL").first()
    if first is None:
        return []
    d, t_count = len(first["_x"]), len(first["_y"])
    dealt = folds.dealt(deviations(kept, ["_t", "_s"], ["_x", "_y"]), "_s", k, kept)
    seen = moments.packed(dealt.select(F.concat_ws("\u0001", "_t", "fold").alias("key"), F.concat("_x", "_y").alias("z")), d + t_count).persist()
    try:
        if d + t_count > moments.MAX_COLUMNS or seen.select("key").distinct().count() * (d + t_count + 1) ** 2 * 8 > moments.MAX_BYTES:
            raise ValueError(f"at most {moments.MAX_COLUMNS} columns, and {moments.MAX_BYTES} bytes of moments")
        centre = np.zeros(d + t_count)
        sums = moments.sums_of_blocks(seen, d + t_count, moments.products(centre))
        parts = {tuple(key.split("\u0001")): moments.Moments(n, gram.reshape(d + t_count + 1, -1).copy(), centre, d) for key, (n, gram) in sums.items()}
        treatments, numbers = sorted({t for t, _ in parts}), sorted({f for _, f in parts})
        sets = {t: (t,) for t in treatments} | {"pooled": tuple(treatments)}
        fit = lambda own: [moments.ridge(own, p, per_weight=True, standardised=True) for p in penalties]
        summed = lambda names, without: {of: m for of, m in parts.items() if of[0] in names and of[1] not in without}
        fitted = {(name, out): fit(moments.total(found)) for name, names in sets.items() for f in numbers for g in numbers for out in [frozenset((f, g))] if (found := summed(names, out))}
        zero = np.zeros((d, t_count)), np.zeros(t_count)
        order = sorted(fitted, key=lambda s: (s[0], sorted(s[1])))
        models, places = {}, {}
        for t, f in parts:
            # a fold is only ever told by models that left it out
            use = [s for s in order if f in s[1]]
            places[t, f] = {s: 1 + i * len(penalties) for i, s in enumerate(use)}
            held = [zero, *(m for s in use for m in fitted[s])]
            models[f"{t}\u0001{f}"] = np.concatenate([b for b, _ in held], axis=1), np.concatenate([c for _, c in held])
        found = {tuple(key.split("\u0001")): (n, e.reshape(-1, t_count)) for key, (n, e) in moments.errors_of_blocks(seen, d, t_count, models).items()}
    finally:
        seen.unpersist()

    def errors(of: tuple[str, str], name: str, out: frozenset) -> np.ndarray | None:
        at = places[of].get((name, out))
        return None if at is None else found[of][1][at : at + len(penalties)]

    rows = []
    for name, names in sets.items():
        pick = {}
        for f in numbers:
            inner = [e for t, g in parts if t in names and g != f and (e := errors((t, g), name, frozenset((f, g)))) is not None]
            pick[f] = sum(inner).argmin(axis=0) if inner else np.full(t_count, len(penalties) - 1)
        for tried in treatments:
            told = [(found[tried, f], errors((tried, f), name, frozenset((f,))), pick[f]) for f in numbers if (tried, f) in found]
            told = [x for x in told if x[1] is not None]
            if not told:
                continue
            n = sum(whole[0] for whole, _, _ in told)
            base = sum(whole[1][0] for whole, _, _ in told)
            off = sum(e[p, np.arange(t_count)] for _, e, p in told)
            rows += [(name, tried, i, float(off[i] / n), float(1 - off[i] / base[i]) if base[i] > 0 else 0.0) for i in range(t_count)]
    return rows
