"""Ranked lexical search with the roles turned: the items are indexed, and the documents stream through the index.

Items are few and documents are many, so the inverted index lies over the items' terms: term -> (item, how often). It is
dealt into blocks of at most ``INDEX_TERMS`` (term, item) entries; a block is broadcast, and every block reads the documents twice:

1. Each task counts, in arrays as long as the block's vocabulary, the documents that hold each term, the documents that
   hold any term at all, and all terms. One row a term and task is summed.
2. Each task counts a document's terms, looks up their postings and adds up the scores of all items for a few documents
   at a time. An item's heap of the ``k`` best (score, document) is updated only by documents that reach its least
   score. A task ends with at most ``k`` rows an item, and these heaps are merged by a ranking with a limit before its
   shuffle.

Words are cut and looked up as Arrow arrays, byte for byte. A text longer than a shard comes in pieces that end between
words, so memory follows the shard, the block and the number of items in it, not the texts. Scores are 64-bit integers.

Defined cases: a null or empty text has no terms and is never found; without any term in the documents nothing is found;
an item without terms, or whose terms stand in no document, has no rows; rows of items with one id are one item, null ids
too; each document row is a document by itself, so a repeated row is found twice, with ranks in a fixed order; a null
doc_id comes after all others on ties; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import ALNUM, LOWER_BYTES, read_table, shards, text_bytes, word_pieces, word_spans
from touchline.llm.registry import query
from touchline.session import settle

#: (term, item) entries of an index block; an item of more distinct terms is a block of its own.
INDEX_TERMS = 1 << 20
SHARD_BYTES = 1 << 20
#: Cells of the (document, item) sums, and postings, that are held at a time.
CELLS = 1 << 20
LENGTH_PER_CENT = 75
BEST = 10
_NULL = np.iinfo(np.int64).max


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of lowered bytes as an Arrow array, and the row of each."""
    begins, finishes, rows = word_spans(data, offsets, ALNUM)
    places = np.concatenate([[0], np.cumsum(finishes - begins)]).astype(np.int32)
    kept = np.ascontiguousarray(data[ALNUM[data]])  # words one after the other
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(kept)]), rows


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term, times) of every item; ``item`` counts the items from 0 in the order of their ids."""
    numbered = items.groupBy(F.col(item_id).alias("item_id")).agg(F.count(F.lit(1)).alias("rows"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, "text", SHARD_BYTES):
            data, offsets = text_bytes(table["text"])
            ids = table["item_id"].combine_chunks()
            for first, bytes_, places in word_pieces(LOWER_BYTES[data], offsets, ALNUM, SHARD_BYTES):
                words, rows = words_of(bytes_, places)
                counted = pa.table({"item_id": ids.take(pa.array(rows + first)), "term": words}).group_by(["item_id", "term"]).aggregate(
                    [([], "count_all")])
                yield from counted.select(["item_id", "term", "count_all"]).rename_columns(["item_id", "term", "times"]).combine_chunks(
                    ).to_batches()

    kind = items.schema[item_id].dataType.simpleString()
    held = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    terms = held.mapInArrow(cut, f"item_id {kind}, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))
    sized = numbered.join(terms.groupBy(F.col("item_id").alias("own")).agg(F.count(F.lit(1)).alias("terms")), F.col("item_id").eqNullSafe(F.col("own")))
    # one row an item: blocks follow from the running number of entries before an item
    before = F.sum("terms").over(Window.orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.select("own", F.floor(F.coalesce(before, F.lit(0)) / INDEX_TERMS).alias("block"))
    return settle(terms.join(placed, F.col("item_id").eqNullSafe(F.col("own"))).drop("own"))


@dataclass
class IndexBlock:
    """Vocabulary of a block, and the (item, times) postings of each term."""
    terms: pa.Array
    starts: np.ndarray
    items: np.ndarray
    times: np.ndarray
    n_items: int
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, entries: pa.Table, keys: pa.Array) -> IndexBlock:
        coded = entries["term"].combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        return cls(coded.dictionary, starts, keys.to_numpy(zero_copy_only=False)[order], entries["times"].to_numpy()[order], int(pc.max(keys).as_py()) + 1)


def _terms_of(table: pa.Table, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of each row, and (row, term, times) of the terms in the index, sorted by row."""
    data, offsets = text_bytes(table["text"])
    n_words, keys, counts = np.zeros(table.num_rows, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, bytes_, places in word_pieces(LOWER_BYTES[data], offsets, ALNUM, SHARD_BYTES):
        words, rows = words_of(bytes_, places)
        rows = rows + first
        n_words += np.bincount(rows, minlength=table.num_rows)
        term = pc.fill_null(pc.index_in(words, terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = term >= 0
        key, times = np.unique(rows[known] * len(terms) + term[known], return_counts=True)
        keys.append(key)
        counts.append(times)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)  # a text in pieces has its terms several times
    times = np.zeros(len(key), np.int64)
    np.add.at(times, place, np.concatenate(counts))
    return n_words, key // max(len(terms), 1), key % max(len(terms), 1), times


def _statistics(docs: DataFrame, shared) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the documents that hold each term of the block."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value.terms
        held, sums = np.zeros(len(terms), np.int64), np.zeros(2, np.int64)
        for table in shards(batches, "text", SHARD_BYTES):
            n_words, _, term, _ = _terms_of(table, terms)
            held += np.bincount(term, minlength=len(terms))
            sums += [(n_words > 0).sum(), n_words.sum()]
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate([seen, [-1, -2]]), "n": np.concatenate([held[seen], sums])})

    got = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got["term"].to_numpy(), got["n"].to_numpy()  # a row for each term of the block at most
    held = np.zeros(len(shared.value.terms), np.int64)
    held[term[term >= 0]] = n[term >= 0]
    return int(n[term == -1].sum()), int(n[term == -2].sum()), held


class Heaps:
    """The ``k`` best (score, doc) of each item, ties to the smaller doc."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, sums: np.ndarray, docs: np.ndarray) -> None:
        """Scores of (document, item); those below an item's least kept score never enter."""
        row, item = np.nonzero(sums >= self.least)
        if not len(row):
            return
        item, score, doc = (np.concatenate(pair) for pair in ((self.item, item), (self.score, sums[row, item]), (self.doc, docs[row])))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        best = rank < self.k
        self.item, self.score, self.doc = item[best], score[order[best]], doc[order[best]]
        full = rank[best] == self.k - 1
        self.least[self.item[full]] = self.score[full]


def score_rows(block: IndexBlock, n_words: np.ndarray, row: np.ndarray, term: np.ndarray, times: np.ndarray, n: int, total: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, scores of (document, item)) for a few documents at a time."""
    longest = LENGTH_PER_CENT * int(n_words.max(initial=0)) * n
    wide = n_words if longest < 1 << 63 else n_words.astype(object)  # products beyond 64 bits; quotients fit again
    length = (100 - LENGTH_PER_CENT + LENGTH_PER_CENT * wide * n // total).astype(np.int64)
    value = block.weights[term] * (1_000_000_000 * times // (1000 * times + 8 * length[row]))
    postings = np.diff(block.starts)
    step = max(1, CELLS // block.n_items)
    for first in range(0, len(n_words), step):
        last = min(first + step, len(n_words))
        sums = np.zeros((last - first) * block.n_items, np.int64)
        low, high = np.searchsorted(row, [first, last])
        grown = np.concatenate([[0], np.cumsum(postings[term[low:high]])])
        while low < high:
            # as many (document, term) pairs as have about CELLS postings, one at least
            base = grown[-1 - (high - low)]
            stop = low + max(1, int(np.searchsorted(grown[-1 - (high - low):], base + CELLS, side="right")) - 1)
            many = postings[term[low:stop]]
            ends = np.cumsum(many)
            place = np.repeat(block.starts[term[low:stop]] - (ends - many), many) + np.arange(ends[-1])
            cell = np.repeat((row[low:stop] - first) * block.n_items, many) + block.items[place]
            np.add.at(sums, cell, np.repeat(value[low:stop], many) * block.times[place])
            low = stop
        yield first, sums.reshape(-1, block.n_items)


def search(docs: DataFrame, items: DataFrame, *, k: int = BEST, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of each item, scores above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    entries = item_terms(items, item_id, text)
    kind = entries.schema["item_id"].dataType.simpleString()
    found = None
    for number in [r[0] for r in entries.select("block").distinct().orderBy("block").collect()]:  # a number for each block
        own = entries.where(F.col("block") == number).select("item_id", "term", "times").toArrow()  # one bounded block
        keys = own["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        block = IndexBlock.of(own, keys.indices)
        shared = spark.sparkContext.broadcast(block)
        n, total, held = _statistics(rows, shared)
        block.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * h + 1))) for h in held.tolist()], np.int64)
        ids = keys.dictionary
        shared = spark.sparkContext.broadcast((block, ids))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, n=n, total=total) -> Iterator[pa.RecordBatch]:
            block, ids = shared.value
            heaps = Heaps(block.n_items, k)
            for table in shards(batches, "text", SHARD_BYTES):
                doc_ids = pc.fill_null(table["doc_id"].combine_chunks(), _NULL).to_numpy(zero_copy_only=False)
                n_words, row, term, times = _terms_of(table, block.terms)
                for first, sums in score_rows(block, n_words, row, term, times, n, total) if total else ():
                    heaps.offer(sums, doc_ids[first:first + len(sums)])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(heaps.item)), pa.array(heaps.doc, mask=heaps.doc == _NULL), pa.array(heaps.score)],
                                             ["item_id", "doc_id", "score"])

        best = rows.mapInArrow(run, f"item_id {kind}, doc_id long, score long")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
size AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM dw WHERE len(w) > 0),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM size),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM dw) GROUP BY r, t),
it AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM benchmark) GROUP BY item_id, t),
weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
score AS (SELECT item_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM it JOIN weight USING (t) JOIN tf USING (t) JOIN size USING (r), total GROUP BY item_id, r),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id
    ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM score JOIN size USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


@query("op12_ranked_search", SQL)
def _(spark, d):
    return search(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))
