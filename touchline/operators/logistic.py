"""Multinomial logistic regression, all folds and strengths in one job per Newton step.

Training rows are packed once, whatever the number of folds they train: a block of numbers holds rows that train the same
folds, and every step reads the blocks. The sums
that a step needs (loss, gradient, curvature) are added up inside tasks, keyed by the fit, and one row for each number and
task is shuffled; the driver solves one small system for each fit. Every training row takes part in every step. A fit begins
at the class shares, where the curvature is one product of its inputs, and keeps a curvature for as long as it brings the
slopes down to a tenth in a step. Fits that have settled leave the job. Nothing but these sums and the parameters reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.trees import softmax
from touchline.session import few_rows_a_file, settle

TOLERANCE = 1e-9
MAX_STEPS = 60
#: Rows that a block holds, or more by the rows of one Arrow batch.
BLOCK_ROWS = 4096
#: A curvature is summed anew once a step leaves more than this share of the slopes.
KEPT_SHARE = 0.1
#: Blocks in a file, and so at a time in a reader.
FILE_BLOCKS = 8


@dataclass(frozen=True)
class Logistic:
    """``strength`` is the ridge penalty on the mean loss; None is one over the rows of the fit."""
    strength: float | None = None


@dataclass
class Logit:
    """Weights on standardised inputs, one row a class; ``gradient`` is the largest slope of the penalised mean loss at the end."""
    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rows: int
    gradient: float = field(default=np.inf)
    steps: int = 0

    def inputs(self, x: np.ndarray) -> np.ndarray:
        filled = (np.where(np.isnan(x), self.fill, x) - self.mean) / self.scale
        return np.concatenate([filled, np.ones((len(x), 1))], 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.inputs(x) @ self.weights.T) if len(x) else np.zeros((0, 3))


def _packed(train: DataFrame, columns: list, base: np.ndarray) -> DataFrame:
    """``train`` (folds, label, inputs) as blocks of rows that train the same folds: those folds, rows, labels and inputs (one
    input after the other) as bytes. Inputs are distances from ``base``, NaN where missing."""
    rows = train.select(F.concat_ws(",", "folds").alias("folds"), F.col("label").cast("int").alias("label"), *[
        F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(columns)])

    def block(key: str, parts: list) -> pa.RecordBatch:
        y, x = np.concatenate([y for y, _ in parts]), np.concatenate([x for _, x in parts], 1)
        return pa.RecordBatch.from_pydict({"folds": [key], "n": pa.array([len(y)], pa.int64()), "y": pa.array([y.tobytes()], pa.binary()),
                                           "x": pa.array([x.tobytes()], pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            of, y = keys.indices.to_numpy(), batch.column(1).to_numpy().astype(np.int8)
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]]) - base[:, None]
            for i, key in enumerate(keys.dictionary.to_pylist()):
                held.setdefault(key, []).append((y[of == i], x[:, of == i]))
                if sum(len(own) for own, _ in held[key]) >= BLOCK_ROWS:
                    yield block(key, held.pop(key))
        for key, parts in held.items():
            yield block(key, parts)

    return rows.mapInArrow(pack, "folds string, n long, y binary, x binary")


def _unpacked(batches: Iterator[pa.RecordBatch], width: int, away: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fold, labels, rows of inputs) of each block and fold that it trains; ``away`` gives what stands for missing inputs."""
    for batch in batches:
        for key, y, x in zip(batch.column("folds").to_pylist(), batch.column("y"), batch.column("x")):
            y, x = np.frombuffer(y.as_buffer(), np.int8), np.frombuffer(x.as_buffer(), float).reshape(width, -1).copy()
            at = np.nonzero(np.isnan(x))
            for k in map(int, key.split(",")):
                if k in away:
                    x[at] = away[k][at[0]]
                    yield k, y, x.T


def _added(blocks: DataFrame, sums) -> dict:
    """{place of the fit: summed numbers}: ``sums`` gives {place: numbers} for the Arrow batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, values in sums(batches).items():
            yield pa.RecordBatch.from_pydict({"fit": pa.array(np.full(len(values), i), pa.int64()), "place": pa.array(np.arange(len(values)), pa.int32()),
                                              "value": values})

    got = blocks.mapInArrow(run, "fit long, place int, value double").groupBy("fit", "place").agg(F.sum("value").alias("value")).toArrow()
    of, place, value = (got[c].to_numpy() for c in ("fit", "place", "value"))
    out = {}
    for i in np.unique(of).tolist():
        own = of == i
        out[i] = np.zeros(int(place[own].max()) + 1)
        out[i][place[own]] = value[own]
    return out


def _medians(train: DataFrame, columns: list) -> dict:
    rows = train.select(F.explode("folds").alias("fold"), *columns)
    return {r.fold: np.array([r[f"m{j}"] for j in range(len(columns))]) for r in rows.groupBy("fold").agg(*[
        F.coalesce(F.percentile_approx(F.col(c).cast("double"), 0.5), F.lit(0.0)).alias(f"m{j}") for j, c in enumerate(columns)]).collect()}


def _moments(blocks: DataFrame, fill: dict, base: np.ndarray, columns: list) -> dict:
    """(rows, median, mean and deviation after filling, class shares) of each fold."""

    def sums(batches: Iterator[pa.RecordBatch]) -> dict:
        held: dict = {}
        for k, y, x in _unpacked(batches, len(columns), away):
            values = np.concatenate([[len(y)], x.sum(0), (x ** 2).sum(0), np.bincount(y, minlength=3)])
            held[k] = held.get(k, 0) + values
        return held

    out, c, away = {}, len(columns), {k: own - base for k, own in fill.items()}
    for k, values in _added(blocks, sums).items():
        n, mean = values[0], values[1:c + 1] / values[0]
        scale = np.sqrt(np.maximum(values[c + 1:2 * c + 1] / n - mean ** 2, 0.0))
        scale[scale <= 1e-12 * (1 + np.abs(base + mean))] = 0.0
        out[k] = int(n), fill[k], base + mean, np.where(scale > 0, scale, 1.0), values[2 * c + 1:] / n
    return out


def fit_many(placed: DataFrame, specs: dict, folds: list, columns: list) -> dict:
    """{(fold, name): Logit} of every spec on the training rows of every fold; ``placed`` has a row for each row, fold and part,
    or each row once with the ``folds`` that it trains."""
    if "folds" in placed.columns:
        train = placed.withColumn("folds", F.filter("folds", lambda k: k.isin(folds))).where(F.size("folds") > 0)
    else:
        train = placed.where((F.col("part") == "train") & F.col("fold").isin(folds)).withColumn("folds", F.array(F.col("fold").cast("long")))
    medians = _medians(train, columns)
    if not medians:
        return {}
    base = medians[max(medians)]
    with few_rows_a_file(train.sparkSession, FILE_BLOCKS):
        blocks = settle(_packed(train, columns, base))
    moments = _moments(blocks, medians, base, columns)
    away = {k: own - base for k, own in medians.items()}
    width, size = len(columns), len(columns) + 1
    fits = {}
    for k in (k for k in folds if k in moments):
        n, fill, mean, scale, shares = moments[k]
        for name in specs:
            weights = np.zeros((3, size))
            weights[:, -1] = np.log(np.maximum(shares, 0.5 / n))
            fits[k, name] = Logit(fill, mean, scale, weights, n)
    strength = {key: specs[key[1]].strength if specs[key[1]].strength is not None else 1.0 / fit.rows for key, fit in fits.items()}
    n_slopes, kept, curves = 3 * size, {}, {}
    open_fits, due = list(fits), set(fits)
    upper = np.triu_indices(size)
    for step in range(1, MAX_STEPS + 1):
        if not open_fits:
            break
        shared = train.sparkSession.sparkContext.broadcast([(key, fits[key], key in due) for key in open_fits])
        flat_start, needed = step == 1, {k: away[k] for k, _ in open_fits}

        def sums(batches: Iterator[pa.RecordBatch], shared=shared, flat_start=flat_start, needed=needed) -> dict:
            held: dict = {}
            for k, y, x in _unpacked(batches, width, needed):
                hit = (y[:, None] == np.arange(3)).astype(float)
                for i, (key, fit, curved) in enumerate(shared.value):
                    if key[0] != k:
                        continue
                    centre, steep = fit.mean - base, fit.weights[:, :-1] / fit.scale
                    p = softmax(x @ steep.T + (fit.weights[:, -1] - steep @ centre))
                    away = p - hit
                    total = away.sum(0)
                    slopes = np.append((away.T @ x - total[:, None] * centre) / fit.scale, total[:, None], 1)
                    values = [slopes.ravel(), [-np.log(np.maximum((p * hit).sum(1), 1e-300)).sum()]]
                    if curved:
                        z = np.append((x - centre) / fit.scale, np.ones((len(x), 1)), 1)
                        values += [(z.T @ z)[upper]] if flat_start else [
                            (z.T @ (z * (p[:, a] * ((a == b) - p[:, b]))[:, None]))[upper] for a in range(3) for b in range(a, 3)]
                    values = np.concatenate(values)
                    held[i] = held.get(i, 0) + values
            return held

        got, left = _added(blocks, sums), []
        for i, key in enumerate(open_fits):
            fit, values = fits[key], got[i]
            ridge = np.tile(np.append(np.full(size - 1, strength[key]), 0.0), 3)
            flat = fit.weights.ravel()
            loss = values[n_slopes] / fit.rows + 0.5 * (ridge * flat ** 2).sum()
            slopes = values[:n_slopes] / fit.rows + ridge * flat
            before, fit.gradient, fit.steps = fit.gradient, float(np.abs(slopes).max()), step
            if fit.gradient <= TOLERANCE:
                continue
            left.append(key)
            if key in kept and loss > kept[key][1] + 1e-12:  # too far: half the way back, with a curvature of that place
                fit.weights = (fit.weights + kept[key][0]) / 2
                fit.gradient = before
                due.add(key)
                continue
            kept[key] = fit.weights, loss
            if key in due:
                curves[key] = _curvature(values[n_slopes + 1:] / fit.rows, size, softmax(fit.weights[None, :, -1])[0] if flat_start else None)
                due.discard(key)
            elif fit.gradient > KEPT_SHARE * before:
                due.add(key)  # this step still uses the old one
            # intercepts are free up to a common shift
            fit.weights = (flat - np.linalg.solve(curves[key] + np.diag(ridge + 1e-10), slopes)).reshape(3, size)
        open_fits = left
    return fits


def _curvature(values: np.ndarray, size: int, shares: np.ndarray | None) -> np.ndarray:
    """Second derivatives of the mean loss: from one block of sums for each two classes, or, where all rows have the same
    ``shares``, from the product of the inputs."""
    upper = np.triu_indices(size)
    blocks = values.reshape(-1, len(upper[0]))
    out, place = np.zeros((3, size, 3, size)), 0
    for a in range(3):
        for b in range(a, 3):
            own = np.zeros((size, size))
            own[upper] = blocks[place] if shares is None else blocks[0] * shares[a] * ((a == b) - shares[b])
            own = own + np.triu(own, 1).T
            out[a, :, b, :] = out[b, :, a, :] = own
            place += 1
    return out.reshape(3 * size, 3 * size)
