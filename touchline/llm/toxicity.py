"""Toxicity classifier: linear weights over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its words (each word with a mark on both sides), so length
alone does not add up. Log-count ratios come from all labelled training rows, by one grouped sum over a hash space of
fixed size. The logistic regression on the scaled features is fitted on at most ``max_train`` of those rows, taken in
the order of a hash, of which only feature numbers travel. Scoring is one pass over the documents with the weights
(one float for each hash cell) broadcast; nothing is shuffled.

Defined cases: a null or empty text has no features and gets the score of the intercept; rows with a null label take
no part in training; a repeated labelled row counts each time; without labelled rows of both kinds every score is
the share of toxic rows smoothed (0.5 for none), still a number from 0 to 1; other columns are carried or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import LOWER_BYTES, SPACED, mix64, read_table, shards, text_bytes, word_pieces
from touchline.llm.registry import query
from touchline.session import settle

CELLS = 1 << 19
GRAMS = (5, 6, 7)
LEAST_ROWS, SMOOTHING = 5, 500.0
MAX_TRAIN = 6000
BROADCAST_ROWS = 1_000_000
THRESHOLD = 0.3
#: Text bytes whose n-grams are held at a time; longer texts come in pieces that end between words.
SHARD_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of the n-grams of all rows, in order of rows and repeated as they occur.

    Every run of white space (and each end of a text) is one mark; n-grams may begin or end at a mark but not cross it.
    """
    n_rows = len(offsets) - 1
    low = LOWER_BYTES[data]
    # a mark before each text and after the last; runs of white space shrink to one mark
    marked = np.zeros(len(low) + n_rows + 1, np.uint8)
    at = np.arange(len(low)) + np.repeat(np.arange(1, n_rows + 1), np.diff(offsets))
    marked[at] = np.where(SPACED[low], low, 0)
    row = np.searchsorted(offsets[1:-1] + np.arange(1, n_rows), np.arange(len(marked)), side="right") if n_rows > 1 else np.zeros(
        len(marked), np.int64)
    keep = np.ones(len(marked), bool)
    keep[1:] = (marked[1:] > 0) | (marked[:-1] > 0)
    marked, row = marked[keep], row[keep].astype(np.int32)
    value = mix64((marked.astype(np.uint64) + np.uint64(1)) * _STEP)
    is_mark = (marked == 0).astype(np.int32)
    cells, rows = [], []
    total = np.concatenate([[0], np.cumsum(is_mark)])
    hashed = np.zeros(len(marked), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(marked) - n + 1
        if m <= 0:
            break
        hashed = hashed[:m] * _STEP + value[n - 1:n - 1 + m]
        if n in GRAMS:
            inner = total[n - 1:n - 1 + m] - total[1:m + 1]  # marks strictly inside
            fine = inner == 0
            got = hashed[fine]
            cells.append(((got ^ (got >> np.uint64(29))) * _STEP >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int32))
            rows.append(row[:m][fine] if n > 1 else row[fine])
    if not cells:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(cells), np.concatenate(rows)


def feature_pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, cells, row of each cell) of pieces; no n-gram crosses white space, so none is lost at a cut."""
    for first, data, offsets in word_pieces(*text_bytes(texts), SPACED, SHARD_BYTES):
        yield first, len(offsets) - 1, *features(data, offsets)


def distinct_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row), each pair once, sorted by row."""
    held = np.zeros(0, np.int64)
    for first, _, cells, rows in feature_pieces(texts):
        pair = (rows.astype(np.int64) + first) * CELLS + cells
        pair = np.concatenate([held, pair]) if len(held) else pair
        pair.sort()
        held = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
    return (held % CELLS).astype(np.int32), (held // CELLS).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out, seen = np.zeros(len(texts)), np.zeros(CELLS, np.int32)
        open_row, used = -1, np.zeros(CELLS, bool)  # cells of the row that a piece broke off in
        for first, n, cells, rows in feature_pieces(texts):
            order = np.argsort(rows, kind="stable")  # few distinct runs: n-gram orders follow each other
            cells, rows = cells[order], rows[order]
            edges = np.searchsorted(rows, np.arange(n + 1))
            for i in range(n):
                own = cells[edges[i]:edges[i + 1]]
                place = np.arange(len(own), dtype=np.int32)
                seen[own] = place
                own = own[seen[own] == place]  # one of each cell
                if first + i == open_row:
                    own = own[~used[own]]
                out[first + i] += self.weights[own].sum(dtype=float)
            if n:
                if first + n - 1 != open_row:
                    open_row, used = first + n - 1, np.zeros(CELLS, bool)
                used[own] = True
        return 1 / (1 + np.exp(-np.clip(out + self.intercept, -500, 500)))


def log_count_ratios(labelled: DataFrame, text: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes log-count ratio of each cell and the number of rows that hold it, over all labelled rows."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, CELLS), np.int64)
        n = np.zeros(2, np.int64)
        for table in shards(batches, text, SHARD_BYTES):
            y = table[label].to_numpy().astype(np.int64)
            cells, rows = distinct_features(table[text])
            for kind in (0, 1):
                sums[kind] += np.bincount(cells[y[rows] == kind], minlength=CELLS)
                n[kind] += (y == kind).sum()
        held = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_pydict({"cell": np.append(held, -1), "clean": np.append(sums[0][held], n[0]),
                                          "toxic": np.append(sums[1][held], n[1])})

    got = labelled.select(text, label).mapInArrow(counts, "cell long, clean long, toxic long").groupBy("cell").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # a row for each hash cell at most
    cell, both = got["cell"].to_numpy(), np.stack([got["clean"].to_numpy(), got["toxic"].to_numpy()]).astype(float)
    sums = np.zeros((2, CELLS))
    sums[:, cell[cell >= 0]] = both[:, cell >= 0]
    n = both[:, cell < 0].sum(1)
    share = (n + 0.5) / (n.sum() + 1)  # smoothing leaves a cell without rows at a ratio of 0
    log = np.log((sums + SMOOTHING * share[:, None]) / (n + SMOOTHING * share)[:, None])
    return log[1] - log[0], np.append(sums.sum(0), n)


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          max_train: int = MAX_TRAIN, penalty: float = 1.0, rounds: int = 60) -> Model:
    """Fit on the documents that ``labels`` (doc_id, label) marks with 0 or 1.

    Log-count ratios count all of them; the regression sees the first ``max_train`` in the order of a hash of the id.
    """
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).cast("long").alias("label"))
    # up to BROADCAST_ROWS labels (two longs each) go to the texts; more of them meet the texts by a shuffle
    few = marks.count() <= BROADCAST_ROWS
    ratio, seen = log_count_ratios(texts.join(F.broadcast(marks) if few else marks, "id"), "text", "label")
    known, (n_clean, n_toxic) = seen[:-2], seen[-2:]
    prior = float(np.log((n_toxic + 0.5) / (n_clean + 0.5)))
    if not n_clean or not n_toxic:
        return Model(np.zeros(CELLS, np.float32), prior if n_clean + n_toxic else 0.0)
    common = docs.sparkSession.sparkContext.broadcast(known >= LEAST_ROWS)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, "text", SHARD_BYTES):
            cells, of = distinct_features(table["text"])
            keep = common.value[cells]
            cells, of = cells[keep], of[keep]
            offsets = np.searchsorted(of, np.arange(table.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays(table["label"].chunks), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells))],
                ["label", "cells"])

    # a written table of max_train short rows, so the planner sees its size; only numbers below CELLS come back
    place = F.xxhash64(F.col("id").cast("string"), F.lit("order"))
    sample = settle(marks.withColumn("place", place).orderBy("place", "id").limit(max_train).drop("place"))
    taken = texts.join(sample, "id").mapInArrow(numbers, "label long, cells array<int>").toArrow()
    y = taken["label"].to_numpy().astype(float)
    lists = [c for c in taken["cells"].chunks if len(c)]
    del taken
    weights, intercept = np.zeros(CELLS), prior
    squares_w, square_b = np.zeros(CELLS), 0.0
    for _ in range(rounds):  # full-batch gradient with a step size for each weight, a few hundred rows at a time
        scaled, gradient, error_sum, begin = (weights * ratio).astype(np.float32), np.zeros(CELLS), 0.0, 0
        for chunk in lists:
            edges, cells = chunk.offsets.to_numpy(), chunk.values.to_numpy()
            for k in range(0, len(edges) - 1, 256):
                e = edges[k:k + 257]
                own, of = cells[e[0]:e[-1]], np.repeat(np.arange(len(e) - 1), np.diff(e))
                z = np.bincount(of, scaled[own], len(e) - 1) + intercept
                error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[begin:begin + len(z)]
                gradient += np.bincount(own, error[of], CELLS)
                error_sum += error.sum()
                begin += len(z)
        gradient = gradient * ratio + penalty * weights
        squares_w += gradient ** 2
        weights -= 0.1 * gradient / (np.sqrt(squares_w) + 1e-8)
        square_b += error_sum ** 2
        intercept -= 0.3 * error_sum / (np.sqrt(square_b) + 1e-8)
    return Model(np.where(known >= LEAST_ROWS, weights * ratio, 0).astype(np.float32), float(intercept))


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, text, SHARD_BYTES):
            yield from table.append_column(name, pa.array(shared.value.score(table[text]))).combine_chunks().to_batches()

    held = docs.select(*[c for c in docs.columns if c.lower() != name.lower()])
    return held.mapInArrow(run, f"{held.schema.toDDL()}, {name} double")


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def train_on_labels(spark, d) -> Model:
    """The model of the labelled documents that may be learned from."""
    labels = read_table(spark, d, "labels").where(remainder(F.col("doc_id"), 4) != 2)
    return train(read_table(spark, d, "documents"), labels)


def remove_toxic(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below ``threshold``, with the columns of ``docs``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    scored = score(docs.toDF(*names), model, text=names[docs.columns.index(text)])
    return scored.where(F.col("score") < threshold).select(*names).toDF(*docs.columns)


@query("op6_toxicity")
def _(spark, d):
    scored = score(read_table(spark, d, "documents").select("doc_id", "text"), train_on_labels(spark, d))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
