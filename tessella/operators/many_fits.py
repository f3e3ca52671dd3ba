"""Many logistic regressions on one table, fitted together.

Fits differ by the group of rows they see (folds, time slices), by penalty and by
the features they may use.  One pass over the rows adds up loss, gradient and
Hessian of all fits that are still open; the driver then takes one proximal
Newton step for each.  So the number of passes is that of the slowest fit, not the sum over
fits.  What a pass brings to the driver is fits times features squared, whatever
the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.quantiles import percentiles
from tessella.operators.series import quoted
from tessella.session import materialize

MAX_PASSES = 200


def prepared_groups(
    rows: DataFrame, group: str, features: list[str], label: str, train: Column | None = None,
    keys: tuple[str, ...] = (), with_mean: bool = True, written: bool = False,
) -> DataFrame:
    """Rows with ``x``, the imputed and scaled features of their group, and ``weight``.

    Medians, means, deviations and balanced class weights of every group come
    from its rows with ``train`` only: all medians from one selection, the rest
    from one aggregation by group.  Groups come from a short list (folds, slices).
    Rows are written before they are read several times, unless they come from a
    ``written`` table by row-wise steps.
    """
    train = F.lit(True) if train is None else train
    rows = rows.select(
        *keys, group, F.col(label).alias("label"), train.alias("is_train"), *[quoted(f).cast("double").alias(f"f{j}") for j, f in enumerate(features)]
    )
    if not written:
        rows = materialize(rows, "groups")
    groups = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]
    k, t = len(features), rows.schema[group].dataType.simpleString()
    used = rows.filter("is_train")
    number = F.create_map(*[v for g, name in enumerate(groups) for v in (F.lit(name), F.lit(g))])[F.col(group)]
    found = percentiles(used, [f"f{j}" for j in range(k)], [0.5], number).collect()
    at = {(r["part"], r["column_name"]): r["value"] for r in found}
    median = {name: [float(at.get((g, f"f{j}"), 0.0)) for j in range(k)] for g, name in enumerate(groups)}
    medians = rows.sparkSession.createDataFrame(list(median.items()), f"{group} {t}, _median array<double>")
    filled = used.join(F.broadcast(medians), group).select(  # one row per group
        group, "label", *[F.coalesce(F.col(f"f{j}"), F.col("_median")[j]).alias(f"f{j}") for j in range(k)]
    )
    by_group = filled.groupBy(group).agg(
        F.array(*[F.avg(f"f{j}") for j in range(k)]).alias("mean"),
        F.array(*[F.stddev_pop(f"f{j}") for j in range(k)]).alias("dev"),
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count("label").alias("n"),
    )
    stats = {r[group]: r for r in by_group.collect()}
    empty = {"mean": [None] * k, "dev": [None] * k, "pos": 0, "n": 0}
    table = []
    for name in groups:
        s = stats.get(name, empty)
        dev = [float(d) if d and d > 0 else 1.0 for d in s["dev"]]
        mean = [float(m or 0.0) if with_mean else 0.0 for m in s["mean"]]
        weight = [s["n"] / (2 * c) if c else 0.0 for c in (s["n"] - s["pos"], s["pos"])]
        table.append((name, median[name], mean, dev, weight))
    known = rows.sparkSession.createDataFrame(
        table, f"{group} {t}, _median array<double>, _mean array<double>, _dev array<double>, _weight array<double>"
    )
    x = [(F.coalesce(F.col(f"f{j}"), F.col("_median")[j]) - F.col("_mean")[j]) / F.col("_dev")[j] for j in range(k)]
    weight = F.when(F.col("label") == 1, F.col("_weight")[1]).otherwise(F.col("_weight")[0])
    ready = rows.join(F.broadcast(known), group).select(  # one row per group
        *keys, group, "label", "is_train", weight.alias("weight"), F.array(*x).alias("x")
    )
    return materialize(ready, "groups-ready")


@dataclass
class Fit:
    """One penalised fit on the rows of ``group``; ``kept`` are its features.

    A fit that ``sees`` other groups is made on theirs instead, so that rows many fits
    share are read once; ``classes`` are then its own weights of labels 0 and 1.
    """

    group: object
    c: float
    l1: bool
    kept: tuple[int, ...]
    sees: tuple = ()
    classes: tuple[float, float] | None = None
    coef: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0


def _objective(loss: float, w: np.ndarray, fit: Fit) -> float:
    size = np.abs(w[:-1]).sum() if fit.l1 else 0.5 * (w[:-1] ** 2).sum()
    return loss + size / fit.c


def _step(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, fit: Fit) -> np.ndarray:
    """Minimiser of the local quadratic plus the penalty, less ``w``."""
    if not fit.l1:
        ridge = np.diag([*[1 / fit.c] * (len(w) - 1), 0.0])
        return -np.linalg.solve(hessian + ridge + 1e-12 * np.eye(len(w)), gradient + ridge @ w)
    new, h = w.copy(), hessian + 1e-12 * np.diag(np.diag(hessian) + 1e-30)
    for _ in range(10_000):
        moved = 0.0
        for j in range(len(w)):
            pull = gradient[j] + h[j] @ (new - w) - h[j, j] * new[j]
            if h[j, j] <= 0:
                continue
            value = -pull if j == len(w) - 1 else -np.sign(pull) * max(abs(pull) - 1 / fit.c, 0.0)
            value /= h[j, j]
            moved = max(moved, abs(value - new[j]) * np.sqrt(h[j, j]))
            new[j] = value
        if moved < 1e-13 * (1 + np.sqrt(np.abs(gradient).max())):
            break
    return new - w


def violation(w: np.ndarray, gradient: np.ndarray, fit: Fit) -> float:
    """How far the subgradient is from zero."""
    g, lam = gradient[:-1], 1 / fit.c
    if fit.l1:
        off = np.where(w[:-1] != 0, np.abs(g + lam * np.sign(w[:-1])), np.maximum(np.abs(g) - lam, 0))
    else:
        off = np.abs(g + lam * w[:-1])
    return float(max(off.max(initial=0.0), abs(gradient[-1])))


def _sums(
    trials: dict[int, tuple[object, tuple[int, ...], np.ndarray]], group: str,
    sees: dict[int, tuple] | None = None, classes: dict[int, tuple[float, float]] | None = None,
):
    """(fit, place, value): loss, gradient and Hessian of each trial on a task's rows."""

    alike: dict[object, dict[tuple, list[int]]] = {}  # trials by group, features and kind of weight
    sees, classes = sees or {}, classes or {}
    for i, (g, kept, _) in trials.items():
        for seen in sees.get(i, (g,)):
            alike.setdefault(seen, {}).setdefault((tuple(kept), i in classes), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros(1 + len(w) + len(w) ** 2) for i, (_, _, w) in trials.items()}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy().reshape(b.num_rows, -1)
            x = np.column_stack([x, np.ones(b.num_rows)])
            y, weight = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("label", "weight"))
            coded = b.column(group).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            for code, g in enumerate(coded.dictionary.to_pylist()):
                if g not in alike:
                    continue
                at = np.flatnonzero(codes == code)
                t = y[at][:, None]
                for (kept, by_class), own in alike[g].items():
                    s = np.where(t == 1, *np.array([classes[i][::-1] for i in own]).T) if by_class else weight[at][:, None]
                    z = x[np.ix_(at, [*kept, x.shape[1] - 1])]
                    m = z @ np.column_stack([trials[i][2] for i in own])
                    small = np.exp(-np.abs(m))
                    p = np.where(m >= 0, 1.0, small) / (1 + small)
                    loss = (s * (np.maximum(m, 0) + np.log1p(small) - t * m)).sum(axis=0)
                    slope = z.T @ (s * (p - t))
                    k = z.shape[1]
                    left, right = np.triu_indices(k)
                    half = (z[:, left] * z[:, right]).T @ (s * p * (1 - p))
                    curve = np.zeros((k, k, len(own)))
                    curve[left, right] = curve[right, left] = half
                    for c, i in enumerate(own):
                        total[i] += np.concatenate([[loss[c]], slope[:, c], curve[:, :, c].ravel()])
        fit = np.repeat(list(total), [len(v) for v in total.values()])
        place = np.concatenate([np.arange(len(v)) for v in total.values()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(fit, pa.int32()), pa.array(place, pa.int32()), pa.array(np.concatenate(list(total.values())))], ["fit", "place", "value"]
        )

    return run


def fit_many(ready: DataFrame, group: str, fits: list[Fit], tol: float = 1e-9) -> list[Fit]:
    """Fit all of ``fits`` on the train rows of ``prepared_groups``.

    Minimises the weighted log loss plus the penalty over C, the intercept free; a
    fit is done when the subgradient, per unit of weight, is within ``tol`` of zero.
    Rows of one class only have no finite optimum: their fit is an infinite intercept.
    """
    train = ready.filter("is_train").select(group, "label", "weight", "x")
    positive = F.count(F.when(F.col("label") == 1, 1))
    sizes = train.groupBy(group).agg(F.sum("weight").alias("m"), positive.alias("pos"), F.count("label").alias("n")).collect()
    sizes = {r[group]: (r["m"] or 0.0, r["n"] - r["pos"], r["pos"]) for r in sizes}
    sees = {i: f.sees or (f.group,) for i, f in enumerate(fits)}
    classes = {i: f.classes for i, f in enumerate(fits) if f.classes}
    held = {i: [sum(sizes[g][k] for g in sees[i] if g in sizes) for k in range(3)] for i in sees}  # weight, rows by class
    mass = {i: classes[i][0] * none + classes[i][1] * some if i in classes else m for i, (m, none, some) in held.items()}
    at = {i: np.zeros(len(f.kept) + 1) for i, f in enumerate(fits)}
    best: dict[int, tuple] = {}  # objective, gradient, hessian at the accepted place
    move: dict[int, tuple] = {}  # direction, length, expected change
    open_ = set(at)
    for i, (_, none, some) in held.items():
        if (none == 0) != (some == 0):
            fits[i].coef, fits[i].intercept = np.zeros(len(fits[i].kept)), np.inf if some else -np.inf
            open_.discard(i)
    if not open_:
        return fits
    for _ in range(MAX_PASSES):
        trials = {i: (fits[i].group, fits[i].kept, at[i] + (move[i][1] * move[i][0] if i in move else 0)) for i in open_}
        got = train.mapInArrow(_sums(trials, group, sees, classes), "fit int, place int, value double").groupBy("fit", "place").agg(F.sum("value").alias("value"))
        sums = {i: np.zeros(1 + len(w) + len(w) ** 2) for i, (_, _, w) in trials.items()}
        for r in got.collect():
            sums[r["fit"]][r["place"]] = r["value"]
        for i, (_, _, w) in trials.items():
            fit, n = fits[i], len(w)
            value = _objective(sums[i][0], w, fit)
            if i in move:
                direction, length, change = move[i]
                # differences within rounding of the sums are no reason to go back
                if value > best[i][0] + 1e-4 * length * change + 1e-10 * abs(best[i][0]) and length > 1e-4:
                    move[i] = direction, length / 2, change
                    continue
            gradient, hessian = sums[i][1 : 1 + n], sums[i][1 + n :].reshape(n, n)
            at[i], best[i] = w, (value, gradient, hessian)
            if violation(w, gradient, fit) <= tol * max(mass[i], 1e-300):
                fit.coef, fit.intercept = w[:-1], float(w[-1])
                open_.discard(i)
                continue
            direction = _step(w, gradient, hessian, fit)
            size = (np.abs(w[:-1] + direction[:-1]).sum() - np.abs(w[:-1]).sum()) / fit.c if fit.l1 else w[:-1] @ direction[:-1] / fit.c
            move[i] = direction, 1.0, float(gradient @ direction + size)
        if not open_:
            return fits
    raise ArithmeticError(f"{len(open_)} logistic fits did not converge in {MAX_PASSES} passes")


def score_many(ready: DataFrame, group: str, fits: list[Fit], out: str = "p") -> DataFrame:
    """Every row under every fit of its group, with the fit's ``c`` and number."""
    k = 1 + max((max(f.kept, default=-1) for f in fits), default=-1)
    table = []
    for i, f in enumerate(fits):
        wide = np.zeros(k)
        wide[list(f.kept)] = f.coef
        table.append((f.group, i, float(f.c), f.intercept, wide.tolist()))
    t = ready.schema[group].dataType.simpleString()
    known = ready.sparkSession.createDataFrame(table, f"_group {t}, fit int, c double, _b double, _w array<double>")
    margin = F.col("_b")
    for j in range(k):
        margin = margin + F.col("x")[j] * F.col("_w")[j]
    scored = ready.join(F.broadcast(known), F.col(group) == F.col("_group"))  # one row per fit
    return scored.withColumn(out, 1 / (1 + F.exp(-margin))).drop("_group", "_b", "_w")


def optimality(ready: DataFrame, group: str, fits: list[Fit]) -> DataFrame:
    """Per fit: its rows, its positives and how far its coefficients are from optimal.

    Coefficients go through a table and the gradient of the weighted loss is
    summed by column expressions, apart from the passes that fitted them.  Zero
    is the optimum: the gradient balances the penalty for every coefficient that is
    not zero and stays within it for those that are.
    """
    rows = score_many(ready.filter("is_train"), group, fits, "p")
    k = max(len(f.kept) for f in fits)
    pull = F.col("weight") * (F.col("p") - F.col("label"))

    def own(j: int) -> Column:
        place = F.create_map(*[v for i, f in enumerate(fits) for v in (F.lit(i), F.lit(f.kept[j] if j < len(f.kept) else -1))])[F.col("fit")]
        return F.when(place >= 0, F.get("x", place)).otherwise(F.lit(0.0))

    sums = rows.groupBy("fit").agg(
        F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("positives"), F.sum("weight").alias("mass"),
        F.sum(pull).alias("free"), F.array(*[F.sum(pull * own(j)) for j in range(k)]).alias("pulls"),
    )
    table = [(i, str(f.group), float(f.c), f.l1, [float(b) for b in f.coef] + [0.0] * (k - len(f.coef)), len(f.kept)) for i, f in enumerate(fits)]
    known = ready.sparkSession.createDataFrame(table, "fit int, group_name string, c double, l1 boolean, coef array<double>, size int")
    both = sums.join(F.broadcast(known), "fit")  # one row per fit

    def off(pair: Column) -> Column:
        g, b, lam = pair["pulls"], pair["coef"], 1 / F.col("c")
        lasso = F.when(b != 0, F.abs(g + lam * F.signum(b))).otherwise(F.greatest(F.abs(g) - lam, F.lit(0.0)))
        return F.when(F.col("l1"), lasso).otherwise(F.abs(g + lam * b))

    worst = F.greatest(F.abs("free"), F.array_max(F.transform(F.slice(F.arrays_zip("pulls", "coef"), F.lit(1), F.col("size")), off)))
    return both.select("fit", "group_name", "c", "size", "n", "positives", (worst / F.col("mass")).alias("violation"))
