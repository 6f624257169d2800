"""Benchmark decontamination with suffix arrays of the training text.

Documents are taken in shards of a few megabytes. A shard's words become symbols (the word's place in the test
vocabulary, 0 for any other word and between documents), its suffix array is refined to the window length, and every
test suffix is found by binary search. Places in the array between both ends of a search are the window's
occurrences; neighbouring occurrences on one diagonal chain into the longest verbatim match of an item in a document.

No document is split over shards, so each shard answers for its own rows and nothing is shuffled. The test side is
cut into blocks of a fixed size in bytes; each block is broadcast to a pass of its own, chained in one job.

Defined cases: a null or empty text has no words; an item without words matches nothing; an item with a null id takes
no part; an item shorter than the window must occur whole; repeated rows are answered row by row; other columns of
both tables are carried or ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import (ALNUM, LOWER_BYTES, read_table, shards, text_bytes, word_hashes, word_spans)
from touchline.llm.registry import query
from touchline.llm.suffix_arrays import refine, search

WINDOW = 10
SHARD_BYTES = 6 << 20
BLOCK_BYTES = 32 << 20

_FOUND = pa.struct([("item_id", pa.string()), ("n_words", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64())])
_SPAN = pa.struct([("begin", pa.int64()), ("finish", pa.int64())])
ADDED = ("n_words long, hit_spans array<struct<begin:long,finish:long>>, "
         "matches array<struct<item_id:string,n_words:long,doc_start:long,item_start:long>>")


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the row of each."""
    data, offsets = text_bytes(texts)
    data = LOWER_BYTES[data]
    begins, finishes, rows = word_spans(data, offsets, ALNUM)
    return word_hashes(data, begins, finishes), rows


class TestBlock:
    """A block of test items: vocabulary, symbols and windows."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.ids, self.window = np.array(ids, dtype=object), window
        hashes, rows = hashed_words(pa.array(texts, pa.string()))
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        self.symbols = symbols.astype(np.int64) + 1
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        counts = np.bincount(rows, minlength=len(ids))
        first = np.cumsum(counts) - counts
        windows = np.where(counts >= window, counts - window + 1, (counts > 0).astype(np.int64))
        self.item = np.repeat(np.arange(len(ids)), windows)
        self.start_in_item = np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.start = first[self.item] + self.start_in_item
        self.length = np.minimum(window, counts)[self.item]

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of training words; 0 for a word that no item holds."""
        out = np.zeros(len(hashes), np.int64)
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(maybe) and len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == hashes[maybe], at + 1, 0)
        return out


def _runs(keys: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (keys, place), and the first of each run whose places rise by one."""
    order = np.lexsort((place, *reversed(keys)))
    fresh = np.ones(len(order), bool)
    if len(order) > 1:
        fresh[1:] = (np.diff(place[order]) != 1)
        for key in keys:
            fresh[1:] |= key[order][1:] != key[order][:-1]
    return order, np.flatnonzero(fresh)


def _lists(rows: np.ndarray, n: int, kind: pa.DataType, fields: list[pa.Array]) -> pa.Array:
    """One list of structs for each of ``n`` rows; ``rows`` is ascending."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))


def match_shard(texts: pa.Array, block: TestBlock, spans: pa.Array | None, matches: pa.Array | None):
    """Word counts, hit spans and longest matches of the shard's rows; earlier passes are taken in."""
    n_rows = len(texts)
    hashes, rows = hashed_words(texts)
    counts = np.bincount(rows, minlength=n_rows)
    first = np.cumsum(counts) - counts
    symbols = np.zeros(len(hashes) + n_rows + 1, np.int64)
    symbols[np.arange(len(hashes)) + rows] = block.encode(hashes)
    order, _ = refine(symbols, 1, block.window)
    low = search(symbols, order, block.symbols, block.start, block.length, right=False)
    high = search(symbols, order, block.symbols, block.start, block.length, right=True)
    found = np.flatnonzero(high > low)
    times = (high - low)[found]
    window = np.repeat(found, times)
    at = order[np.repeat(low[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    row = np.searchsorted(first + np.arange(n_rows), at, side="right") - 1
    place = at - row - first[row]  # word number in the document
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, first[row] + place, 1)
    np.add.at(edge, first[row] + place + block.length[window], -1)
    if spans is not None:
        flat = spans.flatten()
        of = np.repeat(np.arange(n_rows), np.diff(spans.offsets.to_numpy()))
        np.add.at(edge, first[of] + flat.field("begin").to_numpy(), 1)
        np.add.at(edge, first[of] + flat.field("finish").to_numpy(), -1)
    hit = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    order_, heads = _runs([rows[hit]], hit)
    begin, length = hit[order_][heads], np.diff(np.append(heads, len(hit)))
    of = rows[begin]
    span_lists = _lists(of, n_rows, _SPAN, [pa.array(begin - first[of]), pa.array(begin - first[of] + length)])
    # longest match: windows that follow each other in both texts
    item, within = block.item[window], block.start_in_item[window]
    order_, heads = _runs([row, item, place - within], place)
    lead, run = order_[heads], np.diff(np.append(heads, len(order_)))
    size = block.length[window[lead]] + run - 1
    best = np.lexsort((within[lead], place[lead], -size, item[lead], row[lead]))
    lead, size = lead[best], size[best]
    keep = np.ones(len(lead), bool)
    if len(lead) > 1:
        keep[1:] = (row[lead][1:] != row[lead][:-1]) | (item[lead][1:] != item[lead][:-1])
    lead, size = lead[keep], size[keep]
    fields = [block.ids[item[lead]].astype(object), size, place[lead], within[lead]]
    of = row[lead]
    if matches is not None and len(matches.flatten()):
        flat = matches.flatten()
        of = np.concatenate([np.repeat(np.arange(n_rows), np.diff(matches.offsets.to_numpy())), of])
        fields = [np.concatenate([flat.field(f.name).to_numpy(zero_copy_only=False), x]) for f, x in zip(_FOUND, fields)]
        order_ = np.argsort(of, kind="stable")
        of, fields = of[order_], [x[order_] for x in fields]
    match_lists = _lists(of, n_rows, _FOUND, [pa.array(x, f.type) for f, x in zip(_FOUND, fields)])
    return pa.array(counts, pa.int64()), span_lists, match_lists


def _blocks(items: DataFrame, item_id: str, text: str, limit: int) -> list[list]:
    """The test items in blocks of about ``limit`` bytes, each of which may be broadcast."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).where(
        "i is not null")
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-total // limit)
    if n <= 1:
        return [rows.collect()]
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return [rows.where(part == k).collect() for k in range(n)]


def find_contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word ranges that windows cover) and ``matches`` (of each item with an
    occurring window: the longest verbatim match and where it begins in the document and in the item)."""
    clash = {"n_words", "hit_spans", "matches"} & {c.lower() for c in docs.columns}
    out = docs.select(*[c for c in docs.columns if c.lower() not in clash])
    schema = f"{out.schema.toDDL()}, {ADDED}"
    for k, block in enumerate(_blocks(items, item_id, item_text, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(([r.i for r in block], [r.t for r in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, later=k > 0) -> Iterator[pa.RecordBatch]:
            test = TestBlock(*shared.value, window)
            for table in shards(batches, text, SHARD_BYTES):
                table = table.combine_chunks()
                one = lambda c: pa.concat_arrays(table[c].chunks)
                before = (one("hit_spans"), one("matches")) if later else (None, None)
                made = match_shard(table[text], test, *before)
                for name, array in zip(("n_words", "hit_spans", "matches"), made):
                    table = table.set_column(table.column_names.index(name), name, array) if later else table.append_column(name, array)
                yield from table.to_batches()

        out = out.mapInArrow(run, schema)
    return out


def contamination_digest(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, words hit, items and the digest of their ids."""
    found = find_contamination(docs.select("doc_id", "text"), items, window=window)
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["finish"] - s["begin"])
    longest = F.array_max(F.transform("matches", lambda m: m["n_words"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce(longest, F.lit(0)).alias("longest_match"))


def remove_contaminated(docs: DataFrame, items: DataFrame, *, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents in which no window of any item occurs, with the columns of ``docs``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    found = find_contamination(held, items, text=names[docs.columns.index(text)], window=window)
    return found.where(F.size("hit_spans") == 0).select(*names).toDF(*docs.columns)


SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
iw AS (SELECT row_number() OVER () AS k, CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, list_slice(w, p, p + n - 1) AS g FROM
  (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p
   FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, n, unnest(generate_series(1, len(w) - n + 1)) AS p, w FROM dw JOIN sizes ON len(w) >= n),
occ AS (SELECT r, p, win.n, item_id FROM (SELECT r, n, p, list_slice(w, p, p + n - 1) AS g FROM pos) o
  JOIN win ON win.g = o.g AND win.n = o.n),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM
  (SELECT DISTINCT r, unnest(generate_series(p, p + n - 1)) AS q FROM occ) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM occ) GROUP BY r),
runs AS (SELECT r, item_id, d, p, n, p - row_number() OVER (PARTITION BY r, item_id, d, n ORDER BY p) AS g FROM
  (SELECT DISTINCT o.r, o.item_id, o.p, o.n, i.p - o.p AS d, o.g FROM (SELECT r, p, win.n, item_id, win.g FROM
      (SELECT r, n, p, list_slice(w, p, p + n - 1) AS g FROM pos) o JOIN win ON win.g = o.g AND win.n = o.n) o
    JOIN (SELECT k, item_id, n, p, list_slice(w, p, p + n - 1) AS g FROM
      (SELECT k, item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p
       FROM iw WHERE len(w) > 0)) i ON i.item_id = o.item_id AND i.g = o.g)),
longest AS (SELECT r, max(m) AS longest_match FROM
  (SELECT r, n + count(*) - 1 AS m FROM runs GROUP BY r, item_id, d, n, g) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest_match, 0) AS BIGINT) AS longest_match
FROM dw LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN longest USING (r)"""


@query("op7_benchmark_decontamination", SQL)
def _(spark, d):
    return contamination_digest(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))
