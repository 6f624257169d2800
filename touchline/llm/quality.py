"""Quality classifier: a generalised additive model with pairwise interactions, kept as lookup tables.

A text becomes numbers that describe its shape (``FEATURES``): sizes, shares of kinds of bytes, of kinds of words, of words
and lines that repeat. Each feature has at most ``BINS`` bins with borders at quantiles of the training rows. Fitting is
cyclic boosting: round by round and feature by feature, a tree of at most ``LEAVES`` leaves is grown on the bins' sums of
gradient and curvature, and its small step is added to the feature's table, so that a feature never takes what belongs
to another one. Then the ``PAIRS`` pairs of features whose best four quadrants lower the loss most get a table of
coarse bins each, boosted in turn by trees of one cut on either side. A score is the sum of a document's table entries.

Features come from one pass of tasks over the texts. The fit takes at most ``max_train`` labelled rows, the first in the
order of a hash: a documented bound on what reaches the driver (one byte a feature and row). Labels up to that bound are
broadcast. Scoring reads each text once and moves nothing between tasks; the tables are a few thousand numbers.

Defined cases: a null or empty text has the features of zero words and gets a score like any other; rows with a label
other than 0 or 1 take no part; repeated labelled rows count each time; without rows of both labels every score is the
smoothed share of label 1 (0.5 for no rows); documents with null ids are scored but never learned from; a text longer
than a shard comes in pieces that end between words, with the same features (distinct words are counted over the whole
text); other columns are carried, one named like the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import SPACED, read_table, shards, text_bytes, word_hashes, word_pieces, word_spans
from touchline.llm.registry import query
from touchline.llm.toxicity import remainder
from touchline.session import settle

SHARD_BYTES = 1 << 20
MAX_TRAIN = 20_000
THRESHOLD = 0.3
BINS, COARSE = 32, 8
LEAVES, PAIRS = 4, 10
ROUNDS, PAIR_ROUNDS, STEP = 100, 40, 0.1
LEAST_ROWS, PENALTY = 5, 1.0

#: Kinds of bytes; what is none of them is a letter a-z or part of a character outside ASCII.
_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "exclaim": b"!?", "bar": b"|", "symbol": b"#$%&*@^~+=<>\\_`",
          "stop": b".", "comma": b",;:", "bracket": b"()[]{}\"'/-", "space": [0x20, *range(0x09, 0x0E)],
          "control": [*range(9), *range(0x0E, 0x20), 0x7F], "wide": range(0x80, 0x100)}
_NAMES = list(_KINDS)
_KIND_OF = np.zeros(256, np.uint8)
for _i, _bytes in enumerate(_KINDS.values()):
    _KIND_OF[list(_bytes)] = _i
_WORD_COUNTS = ["words", "word_bytes", "long", "caps", "capital", "odd_end", "as_before", "as_two_before", "line_starts", "line_as_before"]
FEATURES = ["log_bytes", "log_words", "mean_word", "longest_word", *[f"{k}_share" for k in _NAMES if k not in ("lower", "space")],
            "upper_of_letters", *[f"{w}_rate" for w in _WORD_COUNTS[2:]], "distinct_rate"]


class _Open:
    """What a text that goes on in the next piece hands over: its last two words, last line start, and distinct words."""
    row, last, line, words = -1, np.zeros(0, np.uint64), np.uint64(0), np.zeros(0, np.uint64)


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    n = len(texts)
    kinds, counts = np.zeros((n, len(_NAMES)), np.int64), np.zeros((n, len(_WORD_COUNTS)), np.int64)
    longest, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)
    held = _Open()
    for first, data, offsets in word_pieces(*text_bytes(texts), SPACED, SHARD_BYTES):
        rows = len(offsets) - 1
        of = np.repeat(np.arange(rows), np.diff(offsets))
        kinds[first:first + rows] += np.bincount(of * len(_NAMES) + _KIND_OF[data], minlength=rows * len(_NAMES)).reshape(rows, len(_NAMES))
        begins, finishes, row = word_spans(data, offsets, SPACED)
        if not len(begins):
            continue
        hashes, size = word_hashes(data, begins, finishes), finishes - begins
        kind, end_kind = _KIND_OF[data[begins]], _KIND_OF[data[finishes - 1]]
        uppers = np.concatenate([[0], np.cumsum(_KIND_OF[data] == 0)])
        lowers = np.concatenate([[0], np.cumsum(_KIND_OF[data] == 1)])
        caps = (uppers[finishes] - uppers[begins] > 1) & (lowers[finishes] == lowers[begins])
        lines = np.concatenate([[0], np.cumsum((data == 10) | (data == 13))])
        carried = held.last if first + row[0] == held.row else np.zeros(0, np.uint64)
        before = np.concatenate([carried, hashes])
        rows_before = np.concatenate([np.full(len(carried), row[0]), row])

        def same(back: int) -> np.ndarray:
            """Words equal to the one ``back`` places before in the same text."""
            out = np.zeros(len(before), bool)
            out[back:] = (before[back:] == before[:-back]) & (rows_before[back:] == rows_before[:-back])
            return out[len(carried):]

        new_line = np.ones(len(row), bool)  # first word of a line; a piece that starts inside a line goes on with it
        new_line[1:] = (row[1:] != row[:-1]) | (lines[begins[1:]] > lines[finishes[:-1]])
        new_line[0] = not len(carried) or lines[begins[0]] > 0
        starts = np.flatnonzero(new_line)
        line = hashes[starts]  # a line is known by its first word
        again = np.zeros(len(row), bool)
        if len(starts):
            previous = np.concatenate([[held.line if len(carried) else np.uint64(0)], line[:-1]])
            row_of = np.concatenate([[row[0] if len(carried) else -1], row[starts][:-1]])
            again[starts] = (line == previous) & (row[starts] == row_of)
        flags = [np.ones(len(row)), size, size > 24, caps, (kind == 0) & ~caps, (end_kind == 3) | (end_kind == 5), same(1), same(2), new_line, again]
        for j, flag in enumerate(flags):
            counts[first:first + rows, j] += np.bincount(row, flag, rows).astype(np.int64)
        np.maximum.at(longest, row + first, size)
        order = np.lexsort((hashes, row))
        fresh = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1]))
        distinct[first:first + rows] += np.bincount(row[order][fresh], minlength=rows)
        begun, end_row = first + row[0] == held.row, row[-1]
        if begun:  # words that an earlier piece of this text has counted
            own = np.unique(hashes[row == row[0]])
            distinct[held.row] -= np.isin(own, held.words).sum()
        own = hashes[row == end_row]
        goes_on = begun and end_row == row[0]
        # only the last text of a piece may go on in the next one
        held.words = held.words[:0] if end_row < rows - 1 else np.union1d(held.words, own) if goes_on else np.unique(own)
        held.last = np.concatenate([carried, own])[-2:] if goes_on else own[-2:]
        held.line = line[-1] if len(starts) and row[starts[-1]] == end_row else held.line
        held.row = first + end_row
    bytes_ = kinds.sum(1)
    words = counts[:, 0]
    per_byte, per_word = np.maximum(bytes_, 1), np.maximum(words, 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
    columns = [np.log1p(bytes_), np.log1p(words), counts[:, 1] / per_word, np.log1p(longest),
               *[kinds[:, i] / per_byte for i, k in enumerate(_NAMES) if k not in ("lower", "space")],
               kinds[:, 0] / letters, *[counts[:, j] / per_word for j in range(2, len(_WORD_COUNTS))], distinct / per_word]
    return np.stack(columns, 1).astype(np.float32) if n else np.zeros((0, len(FEATURES)), np.float32)


# ---- the model --------------------------------------------------------------------------------------------------


def borders(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 borders, by turns at quantiles of all values and of the distinct ones; a value equal to a border
    lies above it. Most rows hold 0 of a rare kind, so that its shares show among the distinct values only."""
    if not len(values):
        return np.zeros(0, np.float32)
    places = np.linspace(0, 1, bins + 1)[1:-1]
    cuts = np.unique(np.concatenate([np.quantile(values, places[::2], method="higher"), np.quantile(np.unique(values), places[1::2], method="higher")]))
    return cuts[cuts > values.min()].astype(np.float32)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], 1).astype(np.uint8) if len(cuts) else np.zeros(
        (len(x), 0), np.uint8)


def _worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def grow(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Step of each bin from a tree of at most ``LEAVES`` leaves: the cut that gains most, again and again."""
    g_sum, h_sum, n_sum = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, n))
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-9, None, None)
        for leaf, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            left_g, left_h = g_sum[at] - g_sum[a], h_sum[at] - h_sum[a]
            right_g, right_h = g_sum[b] - g_sum[at], h_sum[b] - h_sum[at]
            gain = _worth(left_g, left_h) + _worth(right_g, right_h) - _worth(g_sum[b] - g_sum[a], h_sum[b] - h_sum[a])
            gain[np.minimum(n_sum[at] - n_sum[a], n_sum[b] - n_sum[at]) < LEAST_ROWS] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], leaf, int(at[k]))
        if best[1] is None:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = -(g_sum[b] - g_sum[a]) / (h_sum[b] - h_sum[a] + PENALTY)
    return out


def quadrants(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best tree with one cut on either side of a two-way table."""
    def corner(t: np.ndarray) -> list[np.ndarray]:
        c = np.zeros((t.shape[0] + 1, t.shape[1] + 1))
        c[1:, 1:] = t.cumsum(0).cumsum(1)
        inner, side, top, every = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [inner, side - inner, top - inner, every - side - top + inner]

    parts = list(zip(corner(g), corner(h)))
    if not parts[0][0].size:
        return 0.0, np.zeros(g.shape)
    gain = sum(_worth(a, b) for a, b in parts) - _worth(g.sum(), h.sum())
    gain[np.minimum.reduce(corner(n)) < LEAST_ROWS] = 0
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    if gain[i, j] <= 1e-9:
        return 0.0, np.zeros(g.shape)
    step = [-a[i, j] / (b[i, j] + PENALTY) for a, b in parts]
    out = np.empty(g.shape)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = step
    return float(gain[i, j]), out


@dataclass
class Model:
    """Intercept, borders and table of each feature, and (i, j, table) of each pair on coarse bins."""
    intercept: float
    cuts: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        bins, wide = binned(x, self.cuts), binned(x, self.coarse)
        for j, table in enumerate(self.tables):
            out += table[bins[:, j]]
        for i, j, table in self.pairs:
            out += table[wide[:, i], wide[:, j]]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features(texts)), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables on a matrix of features and labels 0 or 1."""
    n_one = float(y.sum())
    intercept = float(np.log((n_one + 0.5) / (len(y) - n_one + 0.5)))
    if not n_one or n_one == len(y):
        return Model(intercept if len(y) else 0.0)
    cuts, coarse = ([borders(x[:, j], k) for j in range(x.shape[1])] for k in (BINS, COARSE))
    bins, wide = binned(x, cuts), binned(x, coarse)
    tables = [np.zeros(len(c) + 1) for c in cuts]
    logit = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            if len(table) == 1:
                continue
            g, h = slopes()
            step = STEP * grow(*(np.bincount(bins[:, j], v, len(table)) for v in (g, h, np.ones(len(y)))))
            table += step
            logit += step[bins[:, j]]

    def sums(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        cell = wide[:, i].astype(np.int64) * shape[1] + wide[:, j]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h, np.ones(len(y))))

    g, h = slopes()
    worth = sorted(((quadrants(*sums(i, j, g, h))[0], i, j) for i, j in combinations(range(len(cuts)), 2)), reverse=True)
    pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in worth[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            step = STEP * quadrants(*sums(i, j, *slopes()))[1]
            table += step
            logit += step[wide[:, i], wide[:, j]]
    for j, table in enumerate(tables):  # each table has a mean of 0 over the training rows; what is taken out goes to the intercept
        mean = table[bins[:, j]].mean()
        table -= mean
        intercept += mean
    return Model(float(intercept), cuts, tables, coarse, pairs)


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          max_train: int = MAX_TRAIN) -> Model:
    """Fit on the documents that ``labels`` (doc_id, label) marks with 0 or 1, at most ``max_train`` of them."""
    place = F.xxhash64(F.col("id").cast("string"), F.lit("order"))
    marks = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).cast("long").alias("label"))
    sample = settle(marks.where("id is not null").withColumn("place", place).orderBy("place", "label").limit(max_train))  # max_train short rows

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, "text", SHARD_BYTES):
            x = features(table["text"])
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield from pa.table({"place": table["place"], "label": table["label"], "x": rows}).combine_chunks().to_batches()

    found = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")
    described = found.mapInArrow(describe, "place long, label long, x array<float>")
    taken = described.orderBy("place", "label", "x").limit(max_train).toArrow()  # an id that many rows share adds no more than the bound
    x = taken["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit(x, taken["label"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of BINS numbers a feature and COARSE ** 2 a pair

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, text, SHARD_BYTES):
            yield from table.append_column(name, pa.array(shared.value.score(table[text]))).combine_chunks().to_batches()

    held = docs.select(*[c for c in docs.columns if c.lower() != name.lower()])
    return held.mapInArrow(run, f"{held.schema.toDDL()}, {name} double")


def tables_of(model: Model, spark: SparkSession) -> DataFrame:
    """The model as rows: (feature, other, bin, other_bin, least, other_least, value); ``other`` is null outside pairs."""
    def least(cuts: np.ndarray, k: int) -> float | None:
        return float(cuts[k - 1]) if k else None

    rows = [(FEATURES[j], None, k, None, least(model.cuts[j], k), None, float(v)) for j, t in enumerate(model.tables) for k, v in enumerate(t)]
    rows += [(FEATURES[i], FEATURES[j], a, b, least(model.coarse[i], a), least(model.coarse[j], b), float(t[a, b]))
             for i, j, t in model.pairs for a in range(t.shape[0]) for b in range(t.shape[1])]
    return spark.createDataFrame([*rows, ("intercept", None, 0, None, None, None, model.intercept)],
                                 "feature string, other string, bin int, other_bin int, least double, other_least double, value double")


@query("op13_quality_classifier")
def _(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, d, "labels").where(remainder(F.col("doc_id"), 5) != 0))
    return score(docs, model).select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
                                     (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
