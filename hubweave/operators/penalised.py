"""Penalised logistic regression of a side on nodes along a path of penalties, for all folds at once.

A model is a fold that is left out (-1: none) and a penalty. A pass over the subjects sums, for every model, the
log-likelihood, its gradient and its curvature (a weighted Gram matrix) at the model's coefficients; tasks send one sum a
block of models. A block's sums meet in one task, which minimises the quadratic form plus the penalty by coordinate
descent, all its models together. Penalties are fitted from the largest one in stretches of bounded size, each starting
from the last stretch's coefficients. The driver holds coefficients only: models x nodes numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubweave.sources.scratch import settled

PENALTIES = 100
CELLS = 1 << 22  # numbers in the Gram matrices of the models of one stretch
BLOCK = 64  # models of a block
PASSES = 100
SWEEPS, SOLVE = 150, 50  # of one pass; the next pass goes on from there
LEAST_WEIGHT = 1e-9  # of a subject in the curvature
LEAST_CHANCE = 1e-5  # in a deviance
FULL = 0.999  # a fold's path ends where its model explains more of its deviance
TOLERANCE = 1e-12  # of the loss without nodes: what a step has to gain


def prepared(rows: DataFrame, nodes: list[str], folds: int, seed: int) -> tuple[DataFrame, list[str]]:
    """A table (y, fold, x) of ``rows`` (side, values) and the nodes in x: those with any value, missing values as the
    mean, standardised with n - 1, a node of one value as 0. The fold is a hash of the values."""
    at = [F.get("values", F.lit(k)) for k in range(len(nodes))]
    numbers = rows.agg(*[f(v).alias(f"{name}{k}") for k, v in enumerate(at) for name, f in (("m", F.avg), ("n", F.count))]).first()
    held = [k for k in range(len(nodes)) if numbers[f"n{k}"]]
    filled = {k: F.coalesce(at[k], F.lit(numbers[f"m{k}"])) for k in held}
    sds = rows.agg(*[F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"s{k}") for k, v in filled.items()]).first() if held else {}
    x = [(v - numbers[f"m{k}"]) / sds[f"s{k}"] if sds[f"s{k}"] > 1e-12 * max(1.0, abs(numbers[f"m{k}"])) else F.lit(0.0) for k, v in filled.items()]
    fold = F.pmod(F.xxhash64(F.lit(seed), "side", "values"), F.lit(folds)).cast("int")
    return settled(rows.select((F.col("side") == 2).cast("double").alias("y"), fold.alias("fold"), F.array(*x).cast("array<double>").alias("x"))), [nodes[k] for k in held]


def _batches(batches, p: int):
    for batch in batches:
        if batch.num_rows:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            yield batch["y"].to_numpy(zero_copy_only=False), batch["fold"].to_numpy(zero_copy_only=False), np.column_stack([np.ones(len(x)), x])


def _moments(p: int):
    """(fold, s): rows, positives, sums, sums of squares and sums with y of each fold."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for y, fold, x in _batches(batches, p):
            for f in np.unique(fold):
                own, t = x[fold == f], y[fold == f]
                sums[f] = sums.get(f, 0) + np.concatenate([own.sum(0), (own[:, 1:] ** 2).sum(0), t @ own])
        for f, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(s), pa.int32()), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], ["fold", "at", "s"])

    return run


def _margins(x: np.ndarray, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    eta = x @ coefficients.T
    return eta, 1 / (1 + np.exp(-np.clip(eta, -700, 700)))


def _sums(state, p: int):
    """(block, load): of a partition's subjects, likelihood, gradient and Gram matrix of each model of the block."""

    def run(batches):
        left_out, now = state.value["fold"], state.value["now"]
        q = p + 1
        total = None
        for y, fold, x in _batches(batches, p):
            total = np.zeros((len(now), 1 + q + q * q)) if total is None else total
            for f in np.unique(left_out):
                models = np.flatnonzero(left_out == f)
                t, z = y[fold != f], x[fold != f]
                eta, chance = _margins(z, now[models])
                total[models, 0] += (t[:, None] * eta - np.logaddexp(0, eta)).sum(0)
                total[models, 1 : 1 + q] += (t[:, None] - chance).T @ z
                weight = np.maximum(chance * (1 - chance), LEAST_WEIGHT)
                for k, m in enumerate(models):
                    total[m, 1 + q :] += ((z * weight[:, k, None]).T @ z).ravel()
        if total is not None:
            for at in range(0, len(now), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([at // BLOCK], pa.int32()), pa.array([total[at : at + BLOCK].tobytes()], pa.binary())], ["block", "load"])

    return run


def _solved(gram: np.ndarray, pull: np.ndarray, b: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray | None:
    """The minimum among points with the signs of b, if it is the minimum of all."""
    on = (b != 0) | (l1 == 0)
    c = np.zeros(len(b))
    c[on] = np.linalg.lstsq((gram + np.diag(l2))[np.ix_(on, on)], (pull - l1 * np.sign(b))[on])[0]
    slope = pull - gram @ c - l2 * c
    stays = ((np.sign(c) == np.sign(b)) | (l1 == 0)).all()
    return c if stays and (np.abs(slope[~on]) <= l1[~on]).all() else None


def _descend(gram: np.ndarray, pull: np.ndarray, start: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Of each model, the minimum of b'Gb / 2 - pull'b + l1'|b| + l2'b^2 / 2 by coordinate descent."""
    b = start.copy()
    slope = pull - np.einsum("mij,mj->mi", gram, b)
    own = np.einsum("mii->mi", gram)
    curve = own + l2
    whole = np.where(curve > 0, curve, 1)
    for sweep in range(1, SWEEPS + 1):
        most = 0.0
        for j in range(b.shape[1]):
            wanted = slope[:, j] + own[:, j] * b[:, j]
            new = np.where(curve[:, j] > 0, np.sign(wanted) * np.maximum(np.abs(wanted) - l1[:, j], 0) / whole[:, j], 0)
            step = new - b[:, j]
            slope -= gram[:, :, j] * step[:, None]
            b[:, j] = new
            most = max(most, (curve[:, j] * step**2).max())
        if most < TOLERANCE / 10:
            break
        if sweep % SOLVE == 0:  # nearly flat matrices take many sweeps: solve for the signs reached so far
            exact = [_solved(*m) for m in zip(gram, pull, b, l1, l2, strict=True)]
            for m, c in enumerate(exact):
                b[m] = b[m] if c is None else c
            if all(c is not None for c in exact):
                break
            slope = pull - np.einsum("mij,mj->mi", gram, b)
    return b


def _steps(state, p: int):
    """(model, objective, accepted, full, gain, after) of the blocks of a partition.

    full: the accepted point explains more than FULL of the deviance; gain: what the next step is expected to gain. A point that is no better than the last accepted one is followed by the point half-way back to that."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, load in zip(batch["block"].to_pylist(), batch["load"], strict=True):
                held[block] = held.get(block, 0) + np.frombuffer(load.as_buffer()).reshape(-1, 2 + p + (p + 1) ** 2)
        s, q = state.value, p + 1
        for block, sums in held.items():
            own = slice(block * BLOCK, block * BLOCK + len(sums))
            n, now, last, l1, l2 = s["n"][own, None], s["now"][own], s["last"][own], s["l1"][own], s["l2"][own]
            objective = -sums[:, 0] / n[:, 0] + (l1 * np.abs(now) + l2 * now**2 / 2).sum(1)
            accepted = objective <= s["objective"][own] + 1e-13
            full = accepted & (-sums[:, 0] / n[:, 0] < (1 - FULL) * s["empty"][own])
            gram, slope = sums[:, 1 + q :].reshape(-1, q, q) / n[:, :, None], sums[:, 1 : 1 + q] / n
            after, gain = (now + last) / 2, np.abs(now - last).max(1)
            if (on := accepted & ~full).any():
                g, b = gram[on], now[on]
                pull = slope[on] + np.einsum("mij,mj->mi", g, b)
                after[on] = _descend(g, pull, b, l1[on], l2[on])

                def loss(c):
                    return np.einsum("mi,mij,mj->m", c, g, c) / 2 + (l1[on] * np.abs(c) - pull * c + l2[on] * c**2 / 2).sum(1)

                gain[on] = loss(b) - loss(after[on])
            models = np.arange(own.start, own.start + len(sums), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(models), pa.array(objective), pa.array(accepted), pa.array(full), pa.array(gain), pa.array(list(after), pa.list_(pa.float64()))], ["model", "objective", "accepted", "full", "gain", "after"])

    return run


def _fit(data: DataFrame, p: int, fold: np.ndarray, n: np.ndarray, l1: np.ndarray, l2: np.ndarray, empty: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coefficients (intercept first) of the models and which are full; those that are or have settled leave the passes."""
    spark, found = data.sparkSession, start.copy()
    now, last, objective = start.copy(), start.copy(), np.full(len(fold), np.inf)
    open_, full = np.arange(len(fold)), np.zeros(len(fold), bool)
    for _ in range(PASSES):
        at = open_
        state = spark.sparkContext.broadcast({"fold": fold[at], "n": n[at], "now": now[at], "last": last[at], "l1": l1[at], "l2": l2[at], "empty": empty[at], "objective": objective[at]})
        sums = data.mapInArrow(_sums(state, p), "block int, load binary").repartition(-(-len(at) // BLOCK), "block")
        got = sums.mapInArrow(_steps(state, p), "model int, objective double, accepted boolean, full boolean, gain double, after array<double>").toPandas()
        state.unpersist()
        model, taken = at[got["model"].to_numpy()], got["accepted"].to_numpy()
        after = np.array(got["after"].tolist()).reshape(-1, p + 1)
        last[model[taken]] = now[model[taken]]
        objective[model[taken]] = got["objective"].to_numpy()[taken]
        found[model] = last[model]
        now[model] = after
        full[model] = got["full"].to_numpy()
        open_ = np.sort(model[(got["gain"].to_numpy() > TOLERANCE * empty[model]) & ~full[model]])
        if not len(open_):
            break
    return found, full


def _deviances(state, p: int):
    """(fold, step, s): summed deviance of the left-out subjects of each fold under the fold's model of each penalty."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for y, fold, x in _batches(batches, p):
            for f in np.unique(fold):
                own = fold == f
                chance = np.clip(_margins(x[own], state.value[f])[1], LEAST_CHANCE, 1 - LEAST_CHANCE)
                t = y[own, None]
                sums[f] = sums.get(f, 0) - 2 * (t * np.log(chance) + (1 - t) * np.log(1 - chance)).sum(0)
        for f, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f] * len(s), pa.int32()), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], ["fold", "step", "s"])

    return run


class Path:
    """Fitted models: ``penalties``; ``coefficients[fold + 1, step]``, intercept first, of standardised ``nodes``;
    ``deviance`` and ``error`` of each penalty; ``least`` and ``within`` (the step of the least cross-validated deviance
    and the first within one standard error of it)."""

    def __init__(self, nodes, penalties, coefficients, deviance, error):
        self.nodes, self.penalties, self.coefficients, self.deviance, self.error = nodes, penalties, coefficients, deviance, error
        self.least = int(np.argmin(deviance))
        self.within = int(np.flatnonzero(deviance <= deviance[self.least] + error[self.least])[0])

    def step(self, choice: str) -> int:
        if choice not in ("min", "1se"):
            raise ValueError("the choice is min or 1se")
        return self.least if choice == "min" else self.within

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, penalty, deviance, error, selected, is_min, is_1se), from the largest penalty on."""
        rows = [(k, float(v), float(self.deviance[k]), float(self.error[k]), int((self.coefficients[0, k, 1:] != 0).sum()), k == self.least, k == self.within) for k, v in enumerate(self.penalties)]
        return spark.createDataFrame(rows, "step int, penalty double, deviance double, error double, selected int, is_min boolean, is_1se boolean")


def path(data: DataFrame, nodes: list[str], alpha: float, folds: int, count: int = PENALTIES) -> Path:
    """Models of a table of prepared() for ``count`` penalties, evenly spaced in logarithm from the least one without a
    selected node down to 1e-4 (1e-2 with fewer subjects than nodes) of it.

    Penalties apply to nodes scaled by their deviation (with n) in the model's own subjects: a share ``alpha`` to absolute
    values, the rest to squares. A fold's path ends where its model explains more than FULL of the deviance (the sides can
    be parted): the last model before that stands for the smaller penalties. A fold without rows of its own has no say in the deviance. If no node varies with the
    side, every penalty is 0 and so is every coefficient but the intercept.
    """
    p = len(nodes)
    sums = np.zeros((folds, 3 * p + 2))
    for r in data.mapInArrow(_moments(p), "fold int, at int, s double").groupBy("fold", "at").agg(F.sum("s").alias("s")).collect():
        sums[r["fold"], r["at"]] = r["s"]
    sizes = sums[:, 0].copy()
    trained = np.concatenate([sums.sum(0, keepdims=True), sums.sum(0) - sums])  # all rows, then all but a fold
    n = np.maximum(trained[:, 0], 1)
    mean = trained[:, 1 : p + 1] / n[:, None]
    sd = np.sqrt(np.maximum(trained[:, p + 1 : 2 * p + 1] / n[:, None] - mean**2, 0))
    share = trained[:, 2 * p + 1] / n
    gap = np.abs(trained[0, 2 * p + 2 :] / n[0] - mean[0] * share[0])
    scaled = np.divide(gap, sd[0], out=np.zeros(p), where=sd[0] > 1e-9)
    top = scaled.max(initial=0) / max(alpha, 1e-3)
    penalties = top * np.logspace(0, -2 if n[0] < p else -4, count)
    found = np.zeros((folds + 1, count, p + 1))
    odds = np.clip(share, LEAST_CHANCE, 1 - LEAST_CHANCE)
    before = np.zeros((folds + 1, p + 1))
    before[:, 0] = np.log(odds / (1 - odds))
    found[:] = before[:, None, :]
    stretch = max(1, CELLS // ((p + 1) ** 2 * (folds + 1)))
    empty = -odds * np.log(odds) - (1 - odds) * np.log(1 - odds)
    going = np.arange(folds + 1) if top > 0 else np.zeros(0, int)
    for at in range(0, count, stretch):
        if not len(going):
            break
        some = penalties[at : at + stretch]
        model = np.repeat(going, len(some))
        weight = np.column_stack([np.zeros(len(model)), sd[model]])
        each = np.tile(some, len(going))[:, None]
        fitted, full = _fit(data, p, model - 1, n[model], alpha * each * weight, (1 - alpha) * each * weight**2, empty[model], before[model])
        ended = full.reshape(len(going), -1)
        for f, own, end in zip(going, fitted.reshape(len(going), len(some), p + 1), ended, strict=True):
            last = int(np.argmax(end)) if end.any() else len(some)
            found[f, at : at + last] = own[:last]
            before[f] = own[last - 1] if last else before[f]
            found[f, at + last :] = before[f]
        going = going[~ended.any(1)]
    state = data.sparkSession.sparkContext.broadcast(found[1:])
    lost = np.zeros((folds, count))
    for r in data.mapInArrow(_deviances(state, p), "fold int, step int, s double").groupBy("fold", "step").agg(F.sum("s").alias("s")).collect():
        lost[r["fold"], r["step"]] = r["s"]
    state.unpersist()
    held = sizes > 0
    means, weights = lost[held] / sizes[held, None], sizes[held] / sizes.sum()
    deviance = weights @ means
    error = np.sqrt(weights @ (means - deviance) ** 2 / max(1, held.sum() - 1))
    return Path(nodes, penalties, found, deviance, error)


def confusion(data: DataFrame, model: np.ndarray) -> DataFrame:
    """(actual, predicted, n) of a table of prepared() under coefficients with the intercept first; side 2 is 1."""
    terms = F.array(*[F.lit(float(c)) for c in model[1:]])
    eta = F.aggregate(F.zip_with("x", terms, lambda a, b: a * b), F.lit(float(model[0])), lambda a, b: a + b)
    return data.groupBy(F.col("y").cast("int").alias("actual"), (eta > 0).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
