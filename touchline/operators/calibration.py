"""Calibration of class probabilities for many groups (model, fold, class) side by side.

The sigmoid is fitted by Newton steps over five grouped sums, one job a step for all groups. Isotonic regression pools
adjacent violators twice: first inside range partitions of (group, x), where all rows are, then over the blocks that are
left. Labels are 0 or 1, so rising block means are distinct fractions whose denominators sum to the rows: a group of n
rows keeps at most about n ** (2/3) blocks. That bounds the second pass and what is broadcast to apply it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import settle

SIGMOID_STEPS = 50
TOLERANCE = 1e-10


def pooled(low: np.ndarray, high: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Adjacent violators pooled: blocks of ascending x with strictly rising means. Runs of violators are pooled together while
    there are many, the rest one after the other; totals and weights are whole numbers, so the order of pooling is of no account."""
    while len(total):
        broken = total[:-1] * weight[1:] >= total[1:] * weight[:-1]
        if broken.sum() * 16 < len(total):
            break
        heads = np.flatnonzero(np.append(True, ~broken))
        low, high = low[heads], high[np.append(heads[1:], len(total)) - 1]
        total, weight = np.add.reduceat(total, heads), np.add.reduceat(weight, heads)
    blocks: list[list] = []
    for a, b, s, w in zip(low.tolist(), high.tolist(), total.tolist(), weight.tolist()):
        while blocks and blocks[-1][2] * w >= s * blocks[-1][3]:
            last = blocks.pop()
            a, s, w = last[0], s + last[2], w + last[3]
        blocks.append([a, b, s, w])
    return tuple(np.array(c, float) for c in zip(*blocks)) if blocks else tuple(np.zeros(0) for _ in range(4))


_BLOCK = "low double, high double, total double, weight double"


def fit_isotonic(scores: DataFrame, group: str = "group") -> DataFrame:
    """(group, low, high, total, weight): the blocks of each group; ``scores`` has group, x and y (0 or 1)."""
    # equal x are one value, so no block border can fall between them
    summed = scores.groupBy(group, "x").agg(F.sum(F.col("y").cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("weight"))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(group).to_numpy(zero_copy_only=False)
            x, total, weight = (batch.column(c).to_numpy() for c in ("x", "total", "weight"))
            edges = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]]) if len(names) else []
            for a, b in zip(edges[:-1], edges[1:]):
                made = pooled(x[a:b], x[a:b], total[a:b], weight[a:b])
                yield pa.RecordBatch.from_pydict({group: [names[a]] * len(made[0]), **dict(zip(("low", "high", "total", "weight"), made))})

    kind = scores.schema[group].dataType.simpleString()
    parts = summed.repartitionByRange(group, "x").sortWithinPartitions(group, "x").mapInArrow(pool, f"{group} {kind}, {_BLOCK}")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("low")
        made = pooled(*(frame[c].to_numpy() for c in ("low", "high", "total", "weight")))
        return pd.DataFrame({group: frame[group].iloc[0], **dict(zip(("low", "high", "total", "weight"), made))})

    return settle(parts.groupBy(group).applyInPandas(merge, f"{group} {kind}, {_BLOCK}"))


def apply_isotonic(rows: DataFrame, blocks: DataFrame, x: str, out: str, group: str = "group") -> DataFrame:
    """``rows`` with the fitted value at ``x``: straight lines between blocks, flat inside and beyond them."""
    held = blocks.toArrow().to_pandas()  # bounded, see above
    lines = {k: (np.stack([g.low, g.high], 1).ravel(), np.repeat((g.total / g.weight).to_numpy(), 2)) for k, g in held.sort_values("low").groupby(group)}
    shared = rows.sparkSession.sparkContext.broadcast(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at = batch.column(group).to_numpy(zero_copy_only=False), batch.column(x).to_numpy()
            value = np.full(len(at), np.nan)
            for name in set(names.tolist()):
                own = names == name
                if name in shared.value:
                    value[own] = np.interp(at[own], *shared.value[name])
            yield batch.append_column(out, pa.array(value))

    return rows.mapInArrow(run, f"{rows.schema.toDDL()}, {out} double")


def fit_sigmoid(scores: DataFrame, group: str = "group") -> DataFrame:
    """(group, slope, shift, gradient): the logistic curve over ``x`` of each group, with smoothed targets."""
    spark, kind = scores.sparkSession, scores.schema[group].dataType.simpleString()
    scores = settle(scores.select(group, "x", "y"))
    sizes = {r[0]: (r[1], r[2]) for r in scores.groupBy(group).agg(F.count(F.lit(1)), F.sum(F.col("y").cast("long"))).collect()}  # a row for each group
    state = {g: [0.0, float(np.log((ones + 1) / (n - ones + 1))), np.inf] for g, (n, ones) in sizes.items()}
    open_groups = list(state)
    for _ in range(SIGMOID_STEPS):
        if not open_groups:
            break
        given = spark.createDataFrame([(g, float(state[g][0]), float(state[g][1]), (sizes[g][1] + 1) / (sizes[g][1] + 2), 1 / (sizes[g][0] - sizes[g][1] + 2))
                                       for g in open_groups], f"{group} {kind}, slope double, shift double, high double, low double")
        p = 1 / (1 + F.exp(-(F.col("slope") * F.col("x") + F.col("shift"))))
        error, curve, at = p - F.when(F.col("y") == 1, F.col("high")).otherwise(F.col("low")), p * (1 - p), F.col("x")
        sums = scores.join(F.broadcast(given), group).groupBy(group).agg(
            *[F.sum(v).alias(n) for n, v in (("ga", error * at), ("gb", error), ("aa", curve * at * at), ("ab", curve * at), ("bb", curve))])
        left = []
        for r in sums.collect():
            own = state[r[0]]
            own[2] = max(abs(r.ga), abs(r.gb)) / sizes[r[0]][0]
            if own[2] <= TOLERANCE:
                continue
            aa, bb = r.aa + 1e-9, r.bb + 1e-9
            step = np.array([bb * r.ga - r.ab * r.gb, aa * r.gb - r.ab * r.ga]) / (aa * bb - r.ab ** 2)
            step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))  # a start far off takes several steps
            own[0], own[1] = own[0] - step[0], own[1] - step[1]
            left.append(r[0])
        open_groups = left
    return spark.createDataFrame([(g, *map(float, s)) for g, s in state.items()], f"{group} {kind}, slope double, shift double, gradient double")


def sigmoid(p: np.ndarray, slope: float, shift: float, least: float) -> np.ndarray:
    """A fitted curve over the logarithm of ``p``."""
    return 1 / (1 + np.exp(-(slope * np.log(np.maximum(p, least)) + shift)))


def apply_sigmoid(rows: DataFrame, curves: DataFrame, x: str, out: str, group: str = "group") -> DataFrame:
    """``rows`` with the curve's value at ``x``; a row for each group is broadcast."""
    value = 1 / (1 + F.exp(-(F.col("slope") * F.col(x) + F.col("shift"))))
    return rows.join(F.broadcast(curves.select(group, "slope", "shift")), group, "left").withColumn(out, value).drop("slope", "shift")
