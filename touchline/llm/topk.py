"""Exact top-k inner products over vectors sorted by length.

Vectors are range-partitioned by descending norm and packed into blocks of a fixed number of rows. The second-moment
matrix (one d x d sum over all rows) gives the directions of a singular value decomposition; rotated into them, the
first components carry most of every inner product. Queries, in blocks too, are first scored against the block of
longest vectors, whose k-th score is a lower bound. Every other pair of blocks then drops in turn the queries whose
norm times the block's longest norm stays below their bound, and the rows whose partial sum plus the product of the
residual norms (Cauchy and Schwarz) does; what is left is scored in exact integers.

Work is one task row per pair of blocks, so no task holds more than a block of either side. Bounds carry a margin for
rounding, and only scores strictly below the k-th are dropped, so ties stay.

Defined cases: a vector that is null, or holds a null or non-finite component, takes no part, nor does a null id; a
shorter vector is padded with zeros; of repeated ids the smallest vector counts; scores beyond a long are clipped to
its range; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import read_table
from touchline.llm.registry import query
from touchline.session import settle

BLOCK_ROWS, QUERY_ROWS, LEADING = 4096, 1024, 16
_PACKED = "part int, top double, ids binary, vectors binary, width int"


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(id, v, norm2): components as floor(scale * x), one row per id."""
    x = F.col(vector)
    fine = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    one = vectors.where(fine).select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(
        F.min("v").alias("v"))
    return one.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), lengths),
        np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Directions of the singular value decomposition, largest first, from one pass over all rows."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("v"), width).astype(float)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "g": total.ravel()})

    cells = vectors.select("v").mapInArrow(moments, "i long, j long, g double").groupBy("i", "j").agg(
        F.sum("g").alias("g")).collect()  # width squared cells, whatever the number of rows
    gram = np.zeros((width, width))
    for c in cells:
        gram[c.i, c.j] = c.g
    return np.linalg.eigh(gram)[1][:, ::-1]


def _packer(width: int, rows: int):
    """Blocks of at most ``rows`` rows of a partition, in its order."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            ids, x = (np.concatenate(a) for a in zip(*held))
            top = float(np.sqrt((x.astype(float) ** 2).sum(1).max()))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "top": [top], "ids": pa.array([ids.tobytes()], pa.binary()),
                "vectors": pa.array([x.tobytes()], pa.binary()), "width": pa.array([width], pa.int32())})

        for batch in batches:
            ids, x = batch.column("id").to_numpy(), _matrix(batch.column("v"), width)
            while len(ids):
                room = rows - sum(len(h[0]) for h in held)
                held.append((ids[:room], x[:room]))
                ids, x = ids[room:], x[room:]
                if sum(len(h[0]) for h in held) == rows:
                    yield flush()
                    held.clear()
        if held:
            yield flush()
    return pack


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise exact inner products."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2 ** 62:
        return np.einsum("ij,ij->i", a, b)
    exact = (a.astype(object) * b.astype(object)).sum(1)
    return np.array([min(max(int(v), -2 ** 63), 2 ** 63 - 1) for v in exact], np.int64)


class _Side:
    """A block: ids, integers, rotated leading components, norms of the rest."""

    def __init__(self, ids: bytes, vectors: bytes, width: int, turn: np.ndarray):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(vectors, np.int64).reshape(len(self.ids), width)
        turned = self.x.astype(float) @ turn
        self.lead = turned[:, :LEADING]
        self.rest = np.sqrt((turned[:, LEADING:] ** 2).sum(1))
        self.norm = np.sqrt((turned ** 2).sum(1))


def best_of(q: _Side, x: _Side, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of all rows of ``x`` that may be among the best k of a query with this lower bound."""
    margin = 1e-9 * (q.norm[:, None] * float(x.norm.max(initial=0)) + 1)
    live = np.flatnonzero(q.norm * x.norm.max(initial=0) + margin[:, 0] >= bound)
    most = q.lead[live] @ x.lead.T + q.rest[live, None] * x.rest[None, :] + margin[live]
    row, col = np.nonzero(most >= bound[live, None])
    row = live[row]
    other = q.ids[row] != x.ids[col]
    row, col = row[other], col[other]
    score = np.concatenate([_products(q.x[row[i:i + 65536]], x.x[col[i:i + 65536]]) for i in range(0, len(row), 65536)]
                           or [np.zeros(0, np.int64)])
    kept = score >= bound[row]
    return _cut(row[kept], x.ids[col[kept]], score[kept], k)


def _cut(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    order = np.lexsort((ids, ~score, row))  # ~score descends without overflow
    row, ids, score = row[order], ids[order], score[order]
    head = np.searchsorted(row, row)
    top = np.arange(len(row)) - head < k
    return row[top], ids[top], score[top]


def top_inner_products(vectors: DataFrame, is_query: Column, *, vec_id: str = "vec_id", vector: str = "embedding",
                       k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products of each query, itself left out.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    base = settle(integer_vectors(vectors, vec_id, vector, scale))
    width = base.agg(F.max(F.size("v"))).first()[0]
    found_kind = "query_id long, vec_id long, score long"
    if not width:
        empty = spark.createDataFrame([], found_kind)
        return empty.select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    turn = spark.sparkContext.broadcast(rotation(base, width))
    blocks = settle(base.repartitionByRange(F.desc("norm2"), "id").sortWithinPartitions(F.desc("norm2"), "id").select(
        "id", "v").mapInArrow(_packer(width, BLOCK_ROWS), _PACKED))
    asked = base.where(is_query)
    n = max(1, -(-asked.count() // QUERY_ROWS))
    queries = asked.select("id", "v").repartition(n).mapInArrow(_packer(width, QUERY_ROWS), _PACKED).select(
        F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    longest = blocks.orderBy(F.desc("top"), "part").limit(1)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = []
            for r in batch.to_pylist():
                q, x = (_Side(r[p + "ids"], r[p + "vectors"], width, turn.value) for p in ("q_", ""))
                row, _, score = best_of(q, x, k, np.full(len(q.ids), -np.inf))
                counts = np.bincount(row, minlength=len(q.ids))
                last = np.where(counts >= k, np.cumsum(counts) - 1, -1)
                bounds.append(np.where(last >= 0, score[last], -np.inf).tobytes() if len(score) else
                              np.full(len(q.ids), -np.inf).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q_ids", "q_vectors")), pa.array(bounds, pa.binary())],
                                             ["q_ids", "q_vectors", "bounds"])

    # one row (the longest block) beside every block of queries
    bounded = settle(queries.withColumn("_one", F.lit(0)).join(
        F.broadcast(longest.select("ids", "vectors", F.lit(0).alias("_one"))), "_one").drop("_one").mapInArrow(
        seed, "q_ids binary, q_vectors binary, bounds binary"))
    parts = blocks.agg(F.max("part")).first()[0]
    pairs = bounded.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts)))).join(
        blocks.select("part", "top", "ids", "vectors"), "part")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("q_ids", "q_vectors", "bounds", "ids", "vectors")}
                q, x = (_Side(r[p + "ids"], r[p + "vectors"], width, turn.value) for p in ("q_", ""))
                row, ids, value = best_of(q, x, k, np.frombuffer(r["bounds"], float))
                yield pa.RecordBatch.from_pydict({"query_id": q.ids[row], "vec_id": ids, "score": value})

    found = pairs.mapInArrow(score, found_kind)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, min(v) AS v FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE))
    AS BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON x.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


@query("op8_exact_top_k", SQL)
def _(spark, d):
    return top_inner_products(read_table(spark, d, "embeddings"), F.col("id") % 100 == 0)
