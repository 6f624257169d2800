"""Bootstrap intervals by reproducible resampling weights.

Each replicate gives every match an independent Poisson(1) weight made from the replicate number and
the match key. Weights are computed and summed where the rows are, many replicates and matches at a time,
and only one partial sum per replicate and task is shuffled, whatever the number of matches. All models
share the weight of a match, which makes comparisons paired.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.probability import row_scores
from touchline.schema import BOOTSTRAP_SAMPLES
from touchline.session import settle

PRIME = 2147483647
DRAWS_PER_TASK = 500_000_000
#: Weights that are computed at a time, near the processor; groups whose sums a task holds.
AT_ONCE, HELD = 1 << 16, 64
# Poisson(1) distribution function at 0, 1, 2, ...; beyond the last entry no 31-bit draw can fall.
POISSON_STEPS = tuple(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(12))


def with_poisson_weight(rows: DataFrame, replicate: str = "rep", slot: str = "slot", name: str = "w") -> DataFrame:
    """Add the Poisson(1) weight of a match in a replicate, by integer mixing that any SQL engine can repeat.

    One column per step: each step uses the one before it twice, and written as one expression the
    steps would be computed again for every use.
    """
    r, x = F.col(replicate), F.col("_x")
    rows = rows.withColumn("_x", (r * 1000003 + F.col(slot) * 7919 + 12345) % PRIME)
    rows = rows.withColumn("_x", (x * x) % PRIME)
    rows = rows.withColumn("_x", (x * 48271 + r) % PRIME)
    rows = rows.withColumn("_x", ((x * x) % PRIME) / F.lit(float(PRIME)))
    steps = sum(((x >= s).cast("int") for s in POISSON_STEPS[1:]), (x >= POISSON_STEPS[0]).cast("int"))
    return rows.withColumn(name, steps).drop("_x")


def _least_draws() -> list[int]:
    """The least 31-bit draw at each step of the distribution function, as ``with_poisson_weight`` compares them."""
    out = []
    for step in POISSON_STEPS:
        draw = max(0, int(step * PRIME) - 2)
        while draw < PRIME and draw / float(PRIME) < step:
            draw += 1
        out.append(draw)
    return out


def _folded(v: np.ndarray, high: np.ndarray) -> None:
    """``v`` in place by a smaller number with the same rest by the prime, which is 2 ** 31 - 1."""
    np.right_shift(v, 31, out=high)
    np.bitwise_and(v, PRIME, out=v)
    np.add(v, high, out=v)


def poisson_weights(first: int, last: int, slots: np.ndarray) -> np.ndarray:
    """The weights of ``with_poisson_weight``, a row for each replicate from ``first`` to ``last`` and a column for each slot."""
    rep = np.arange(first, last + 1, dtype=np.uint64)[:, None]
    v = rep * np.uint64(1000003) + (slots.astype(np.uint64) * np.uint64(7919) + np.uint64(12345))
    high = np.empty_like(v)
    _folded(v, high)
    np.multiply(v, v, out=v)
    _folded(v, high)
    np.multiply(v, np.uint64(48271), out=v)
    np.add(v, rep, out=v)
    _folded(v, high)
    np.multiply(v, v, out=v)
    for _ in range(3):
        _folded(v, high)
    draw, beyond = v.astype(np.int32), np.empty(v.shape, bool)
    draw[draw == PRIME] = 0
    out = np.zeros(v.shape, np.int8)
    for least in _least_draws():
        np.greater_equal(draw, least, out=beyond)
        np.add(out, beyond.view(np.int8), out=out)
    return out


def _weighted_sums(slots: np.ndarray, values: np.ndarray, samples: int) -> np.ndarray:
    """Sums of the weights and of the weighted ``values`` (a row a match) of every replicate."""
    held, out = np.concatenate([np.ones((len(slots), 1)), values], 1), np.zeros((samples, 1 + values.shape[1]))
    for k in range(0, len(slots), AT_ONCE >> 4):
        own, part = slots[k:k + (AT_ONCE >> 4)], held[k:k + (AT_ONCE >> 4)]
        step = max(1, AT_ONCE // len(own))
        for r in range(0, samples, step):
            last = min(samples, r + step)
            out[r:last] += poisson_weights(r + 1, last, own).astype(float) @ part
    return out


def slot_of(key: str, kind: str = "bigint") -> Column:
    """A number below the prime for a match key; text keys are hashed."""
    number = F.col(key) if kind == "bigint" else F.xxhash64(key)
    return F.pmod(number, F.lit(PRIME))


def replicate_sums(rows: DataFrame, keys: list, values: list, match_key: str = "match_id",
                   samples: int = BOOTSTRAP_SAMPLES) -> DataFrame:
    """Weighted sums of ``values`` and of the weights, per key and replicate."""
    slot = slot_of(match_key, dict(rows.dtypes)[match_key])
    rows = settle(rows.select(*keys, *[F.col(v).cast("double").alias(v) for v in values], slot.alias("slot")))
    # Little data, much work per row: spread it by work, not by bytes.
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() * samples // DRAWS_PER_TASK)
    kinds = ", ".join([rows.select(*keys).schema.toDDL(), "rep long, w long", *[f"{v} double" for v in values]])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def parts() -> Iterator[pa.RecordBatch]:
            for group, (sums, known) in held.items():
                columns = [pa.array([k.as_py()] * samples, k.type) for k in group]
                columns += [pa.array(np.arange(1, samples + 1)), pa.array(sums[:, 0].astype(np.int64))]
                columns += [pa.array(sums[:, 1 + j], mask=np.full(samples, not known[j])) for j in range(len(values))]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "rep", "w", *values])

        for batch in batches:
            code = np.zeros(batch.num_rows, np.int64)
            for k in keys:
                own = batch.column(k).dictionary_encode("encode")
                code = code * (len(own.dictionary) + 1) + own.indices.to_numpy()
            slots = batch.column("slot").to_numpy()
            given = np.stack([batch.column(v).is_valid().to_numpy(zero_copy_only=False) for v in values], 1)
            numbers = np.stack([batch.column(v).fill_null(0.0).to_numpy() for v in values], 1)
            for c in np.unique(code):
                at = np.flatnonzero(code == c)
                group = tuple(batch.column(k)[int(at[0])] for k in keys)
                sums, known = _weighted_sums(slots[at], numbers[at], samples), given[at].any(0)
                if group in held:
                    sums, known = held[group][0] + sums, held[group][1] | known
                held[group] = sums, known
            if len(held) >= HELD:
                yield from parts()
                held.clear()
        yield from parts()

    # a replicate that draws no match of a key has no row there
    return rows.repartition(int(tasks)).sortWithinPartitions(*keys).mapInArrow(draw, kinds).groupBy(*keys, "rep").agg(
        F.sum("w").alias("w"), *[F.sum(v).alias(v) for v in values]).where("w > 0")


def _interval(value: Column, name: str, confidence: float = 0.95) -> list:
    tail = (1 - confidence) / 2
    return [F.avg(value).alias(f"{name}_mean"), F.percentile(value, F.lit(tail)).alias(f"{name}_ci_low"),
            F.percentile(value, F.lit(1 - tail)).alias(f"{name}_ci_high")]


def bootstrap_metrics(predictions: DataFrame, keys: list | None = None, samples: int = BOOTSTRAP_SAMPLES) -> DataFrame:
    """Mean and 95 % interval of RPS, log loss, accuracy and Brier score per model."""
    keys = keys or ["model"]
    metrics = ["rps", "log_loss", "correct", "brier"]
    sums = replicate_sums(row_scores(predictions), keys, metrics, samples=samples)
    return sums.groupBy(*keys).agg(*[c for m in metrics for c in _interval(F.col(m) / F.col("w"), m.replace("correct", "accuracy"))])


def paired_losses(predictions: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Per-match loss differences of two models on the matches both have."""
    rows = row_scores(predictions.where(F.col("model").isin(model_a, model_b)))
    of = lambda name, c: F.max(F.when(F.col("model") == name, F.col(c)))
    return (
        rows.groupBy("match_id")
        .agg(*[(of(model_a, c) - of(model_b, c)).alias(f"delta_{c}") for c in ("rps", "log_loss")])
        .where(F.col("delta_rps").isNotNull())
    )


def all_paired_losses(predictions: DataFrame, baseline: str) -> DataFrame:
    """Loss differences of every model to the baseline on common matches."""
    rows = row_scores(predictions).select("match_id", "model", "rps", "log_loss")
    base = rows.where(F.col("model") == baseline).select("match_id", F.col("rps").alias("b_rps"), F.col("log_loss").alias("b_log_loss"))
    return rows.where(F.col("model") != baseline).join(base, "match_id").select(
        "match_id", "model", (F.col("rps") - F.col("b_rps")).alias("delta_rps"),
        (F.col("log_loss") - F.col("b_log_loss")).alias("delta_log_loss"))


def bootstrap_differences(deltas: DataFrame, keys: list, samples: int = BOOTSTRAP_SAMPLES) -> DataFrame:
    """Interval of the mean difference, share of replicates without improvement, and both significance rules."""
    values = ["delta_rps", "delta_log_loss"]
    sums = replicate_sums(deltas, keys, values, samples=samples)
    observed = deltas.groupBy(*keys).agg(F.count("*").alias("n_matches"), *[F.avg(v).alias(f"observed_{v}") for v in values])
    found = sums.groupBy(*keys).agg(
        *[c for v in values for c in _interval(F.col(v) / F.col("w"), v)],
        F.avg((F.col("delta_rps") >= 0).cast("double")).alias("p_value_not_better"))
    return observed.join(found, keys).withColumns({
        "significant_by_p": F.col("p_value_not_better") < 0.05,
        "significant_by_interval": F.col("delta_log_loss_ci_low") * F.col("delta_log_loss_ci_high") > 0})


def bootstrap_home_advantage_gap(rows: DataFrame, keys: list, samples: int = BOOTSTRAP_SAMPLES) -> DataFrame:
    """Interval of the home-advantage difference of subset ``empty`` minus ``normal``.

    ``rows`` holds the weighted home goals and rates of each match, so a replicate is two sums per subset.
    """
    sums = replicate_sums(rows, keys + ["subset"], ["scored", "expected"], samples=samples)
    of = lambda s, c: F.max(F.when(F.col("subset") == s, F.col(c)))
    gap = F.ln(of("empty", "scored") / of("empty", "expected")) - F.ln(of("normal", "scored") / of("normal", "expected"))
    return sums.groupBy(*keys, "rep").agg(gap.alias("gap")).groupBy(*keys).agg(*_interval(F.col("gap"), "gap")).withColumn(
        "significant", F.col("gap_ci_low") * F.col("gap_ci_high") > 0)
