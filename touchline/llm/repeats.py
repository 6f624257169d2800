"""Removal of long byte strings that stand more than once: suffix arrays per shard, merged across shards.

A string of ``length`` bytes that repeats holds the same smallest 64-byte hash (its anchor) at the same place in each
of its occurrences. So strings are first sorted out by anchor, which loses none:

1. Each document's strings fall into runs that share an anchor; a run is known by its anchor and by a hash of all its
   bytes. One pass counts (anchor, run) over all documents. An anchor that stands once has no repeats; a whole run
   that stands twice is repeated throughout, which settles copies of any number as one counted row.
2. What is left are anchors with different runs: the borders of shared passages. Documents are dealt to shards of a
   few megabytes, and each shard builds a suffix array of its open runs by rank doubling, with Kasai's common prefixes;
   neighbours that share ``length`` bytes are repeated.
3. Across shards: the sorted, distinct fingerprints of a shard's strings are cut into ranges; a range's lists meet in
   one task, each is looked up in the others by binary search, and the answers go back to their shards.

Every (anchor, run) moves once per shard at most, so passages that a third of all documents share make no hot group.
Fingerprints across shards have 64 bits, (anchor, run) has 128; two different strings are taken for one with a
probability of about n * n / 2**65 for n open strings, 1e-4 for 60 million.

Defined cases: a null or empty text has no bytes and nothing to remove; a text shorter than ``length`` is left alone;
matches never cross documents; repeated rows repeat each other; removed bytes may leave half a character, so what is
left is bytes; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import BYTE_VALUES, mix64, powers, read_table, shards, text_bytes
from touchline.llm.registry import query
from touchline.llm.suffix_arrays import common_prefixes, refine
from touchline.session import settle

LENGTH, ANCHOR = 200, 64
SHARD_BYTES, STEP_BYTES = 3 << 20, 1 << 20
RANGE_STRINGS = 1_000_000
_WHOLE, _OPEN = 1, 2


class Runs:
    """Anchored runs of the strings of a piece of a shard."""

    def __init__(self, texts: pa.Array, length: int):
        self.data, self.offsets = text_bytes(texts)
        n = len(self.data)
        power, inverse = powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[self.data] * power[:n], out=self.total[1:])
        self.inverse, self.length = inverse, length
        sizes = np.diff(self.offsets)
        doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
        first = np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0)
        start = np.arange(len(doc)) - first[doc] + self.offsets[doc]
        self.first = self.last = self.doc = np.zeros(0, np.int64)
        self.anchor = self.run = np.zeros(0, np.uint64)
        if not len(start):
            return
        hashes = self.hash_of(np.arange(n - ANCHOR + 1), ANCHOR)
        bits = np.uint64(max(1, int(n).bit_length()))
        packed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
        width, span = 1, length - ANCHOR + 1
        while width * 2 <= span:  # minimum over a power of two, then over the span by two of them
            packed = np.minimum(packed[:-width], packed[width:])
            width *= 2
        if span > width:
            packed = np.minimum(packed[:len(packed) - (span - width)], packed[span - width:])
        place = (packed[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        head = np.ones(len(start), bool)
        head[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(head)
        self.first, self.last, self.doc = start[at], start[np.append(at[1:], len(start)) - 1], doc[at]
        self.anchor = hashes[place[at]]
        size = self.last - self.first + length
        self.run = self.hash_between(self.first, self.first + size)
        self.run = mix64(self.run ^ mix64(size.astype(np.uint64) << np.uint64(20) | (place[at] - self.first).astype(np.uint64)))

    def hash_between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.total[end] - self.total[begin]) * self.inverse[begin])

    def hash_of(self, begin: np.ndarray, size: int) -> np.ndarray:
        return self.hash_between(begin, begin + size)


def _distinct(rows: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of parallel columns, and how often each stands."""
    if not len(rows[0]):
        return rows, np.zeros(0, np.int64)
    order = np.lexsort(rows[::-1])
    rows = [r[order] for r in rows]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.logical_or.reduce([r[1:] != r[:-1] for r in rows])
    at = np.flatnonzero(fresh)
    return [r[at] for r in rows], np.diff(np.append(at, len(order)))


def _count_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches, "text", STEP_BYTES):
            runs = Runs(table["text"], length)
            (shard, anchor, whole), n = _distinct([table["shard"].to_numpy()[runs.doc], runs.anchor, runs.run])
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "anchor": anchor.view(np.int64),
                                              "run": whole.view(np.int64), "n": n})
    return run


def _flags_of(runs: Runs, known: tuple[np.ndarray, np.ndarray], flags: np.ndarray) -> np.ndarray:
    """Flags of the piece's runs; ``known`` is (anchor, run), sorted by a mix of both."""
    keys = mix64(known[0] ^ mix64(known[1]))
    own = mix64(runs.anchor ^ mix64(runs.run))
    at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
    return np.where(keys[at] == own, flags[at], 0) if len(keys) else np.zeros(len(own), np.int64)


def _spans(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    covered = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
    step = np.diff(covered)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


_FIRST = "doc_id long, shard int, n_bytes long, text binary, begins array<long>, finishes array<long>, open array<long>, prints array<long>, kept_sha256 string"


def _kept(data: np.ndarray, begins: np.ndarray, finishes: np.ndarray) -> str:
    edge = np.zeros(len(data) + 1, np.int32)
    edge[begins] += 1
    edge[finishes] -= 1
    return hashlib.sha256(data[np.cumsum(edge[:-1]) == 0].tobytes()).hexdigest()


def _solve_shard(length: int):
    """Documents of a shard beside the flags of its (anchor, run): settled spans, and the strings still open."""
    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        anchor, whole, flag, tells = (flags[c].to_numpy() for c in ("anchor", "run", "flag", "tells"))
        anchor, whole = anchor.view(np.uint64), whole.view(np.uint64)
        order = np.argsort(mix64(anchor ^ mix64(whole)))
        anchor, whole, flag = anchor[order], whole[order], (flag + 4 * tells)[order]
        rows, opened = [], []  # opened: (row, place in the row, symbols of the run)
        told: set[tuple[int, int]] = set()
        for table in shards(iter(docs.to_batches()), "text", STEP_BYTES):
            runs = Runs(table["text"], length)
            own = _flags_of(runs, (anchor, whole), flag)
            edge = np.zeros(len(runs.data) + table.num_rows, np.int32)  # a place more for each document's end
            repeated = (own & _WHOLE) > 0
            np.add.at(edge, (runs.first + runs.doc)[repeated], 1)
            np.add.at(edge, (runs.last + length + runs.doc)[repeated], -1)
            base = len(rows)
            for i in np.flatnonzero((own & _OPEN) > 0):
                if repeated[i]:  # one copy speaks for a repeated run, in one shard
                    key = (int(runs.anchor[i]), int(runs.run[i]))
                    if not own[i] & 4 or key in told:
                        continue
                    told.add(key)
                opened.append((base + int(runs.doc[i]), int(runs.first[i] - runs.offsets[runs.doc[i]]),
                               runs.data[runs.first[i]:runs.last[i] + length]))
            for r in range(table.num_rows):
                x, y = int(runs.offsets[r]), int(runs.offsets[r + 1])
                rows.append([table["doc_id"][r].as_py(), runs.data[x:y], edge[x + r:y + r + 1], [], []])
        if opened:
            sizes = np.array([len(o[2]) for o in opened])
            symbols = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
            begin = np.cumsum(sizes + 1) - sizes - 1
            inner = np.repeat(begin, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            flat = np.concatenate([o[2] for o in opened])
            symbols[inner] = flat.astype(np.int64) + 1
            rank = symbols.copy()
            for k in (1, 2, 3):  # four symbols of nine bits to begin with
                rank <<= 9
                rank[:-k] += symbols[k:]
            rank[symbols == 0] = 0
            order, _ = refine(rank, 4, length)
            shared = common_prefixes(symbols, order) >= length
            both = shared.copy()
            both[:-1] |= shared[1:]
            again = np.zeros(len(symbols), bool)
            again[order] = both
            power, inverse = powers(len(flat) + 1)
            total = np.zeros(len(flat) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[flat] * power[:len(flat)], out=total[1:])
            flat_begin = np.cumsum(sizes) - sizes
            for k, (row, place, _) in enumerate(opened):
                strings = int(sizes[k]) - length + 1
                at = flat_begin[k] + np.arange(strings)
                prints = mix64((total[at + length] - total[at]) * inverse[at])
                hit = again[begin[k]:begin[k] + strings]
                edge = rows[row][2]
                np.add.at(edge, place + np.flatnonzero(hit), 1)
                np.add.at(edge, place + np.flatnonzero(hit) + length, -1)
                rows[row][3].append(place + np.arange(strings))
                rows[row][4].append(prints)
        out = {c: [] for c in ("doc_id", "n_bytes", "text", "begins", "finishes", "open", "prints", "kept_sha256")}
        for doc_id, data, edge, places, prints in rows:
            begins, finishes = _spans(edge[:-1])
            out["doc_id"].append(doc_id)
            out["n_bytes"].append(len(data))
            out["begins"].append(begins)
            out["finishes"].append(finishes)
            out["open"].append(np.concatenate(places) if places else [])
            out["prints"].append(np.concatenate(prints).view(np.int64) if prints else [])
            out["text"].append(data.tobytes() if places else None)
            out["kept_sha256"].append(None if places else _kept(data, begins, finishes))
        shard = docs["shard"][0].as_py() if docs.num_rows else 0
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "text": pa.binary(), "kept_sha256": pa.string()}
        made = {c: pa.array(v, kinds.get(c, pa.list_(pa.int64()))) for c, v in out.items()}
        made["shard"] = pa.array(np.full(len(rows), shard), pa.int32())
        return pa.table({c: made[c] for c in ("doc_id", "shard", "n_bytes", "text", "begins", "finishes", "open", "prints", "kept_sha256")})
    return run


def _deal_prints(ranges: int):
    """Sorted distinct fingerprints of each shard, cut into ranges."""
    def run(table: pa.Table) -> pa.Table:
        prints = np.unique(table["prints"].combine_chunks().flatten().to_numpy().view(np.uint64)) if table.num_rows else np.zeros(0, np.uint64)
        width = (1 << 64) // ranges + 1
        cut = np.searchsorted(prints, np.array([k * width for k in range(1, ranges)], np.uint64))
        parts = np.split(prints, cut)
        held = [k for k, p in enumerate(parts) if len(p)]
        shard = table["shard"][0].as_py() if table.num_rows else 0
        return pa.table({"range": pa.array(held, pa.int32()), "shard": pa.array([shard] * len(held), pa.int32()),
                         "prints": pa.array([parts[k].tobytes() for k in held], pa.binary())})
    return run


def _merge_range(table: pa.Table) -> pa.Table:
    """Which fingerprints of each list stand in another list too: binary search in the merged lists."""
    lists = [np.frombuffer(p.as_buffer(), np.uint64) for p in table["prints"]]
    merged = np.sort(np.concatenate(lists))
    twice = [p[np.searchsorted(merged, p, "right") - np.searchsorted(merged, p, "left") > 1] for p in lists]
    return pa.table({"shard": table["shard"].combine_chunks(), "repeated": pa.array([t.tobytes() for t in twice], pa.binary())})


def _finish(length: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        known = np.sort(np.concatenate([np.frombuffer(p.as_buffer(), np.uint64) for p in answers["repeated"]] or [np.zeros(0, np.uint64)]))
        out = {c: [] for c in ("doc_id", "n_bytes", "begins", "finishes", "kept_sha256")}
        for i in range(docs.num_rows):
            data = np.frombuffer(docs["text"][i].as_buffer(), np.uint8)
            edge = np.zeros(len(data) + 1, np.int32)
            edge[docs["begins"][i].values.to_numpy()] += 1
            edge[docs["finishes"][i].values.to_numpy()] -= 1
            prints, places = docs["prints"][i].values.to_numpy().view(np.uint64), docs["open"][i].values.to_numpy()
            at = np.minimum(np.searchsorted(known, prints), max(0, len(known) - 1))
            hit = places[known[at] == prints] if len(known) else places[:0]
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + length, -1)
            begins, finishes = _spans(edge[:-1])
            for c, v in zip(out, (docs["doc_id"][i].as_py(), len(data), begins, finishes, _kept(data, begins, finishes))):
                out[c].append(v)
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "kept_sha256": pa.string()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.list_(pa.int64()))) for c, v in out.items()})
    return run


def find_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, begins, finishes, kept_sha256): the byte spans to remove, and the digest of what is left."""
    if length < 2 * ANCHOR:
        raise ValueError(f"strings are at least {2 * ANCHOR} bytes long")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(1, -(-total // shard_bytes))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text", F.lit(2)), F.lit(n_shards)).cast("int"))
    counted = settle(dealt.where(F.octet_length("text") >= length).select("shard", "text").mapInArrow(
        _count_runs(length), "shard int, anchor long, run long, n long"))
    shared = settle(counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
    known = settle(counted.join(shared, "anchor", "left_semi").groupBy("anchor", "run", "shard").agg(F.sum("n").alias("n")))
    each = settle(known.groupBy("anchor", "run").agg(F.sum("n").alias("n"), F.min("shard").alias("teller")))
    many = settle(each.groupBy("anchor").agg(F.count("*").alias("runs")).where("runs > 1").select("anchor", F.lit(_OPEN).alias("open")))
    flagged = each.join(many, "anchor", "left").withColumn(
        "flag", F.when(F.col("n") > 1, _WHOLE).otherwise(0) + F.coalesce("open", F.lit(0))).select("anchor", "run", "flag", "teller")
    flags = known.select("anchor", "run", "shard").join(settle(flagged), ["anchor", "run"]).select(
        "shard", "anchor", "run", F.col("flag").cast("long").alias("flag"), (F.col("shard") == F.col("teller")).cast("long").alias("tells"))
    solved = settle(dealt.groupBy("shard").cogroup(flags.groupBy("shard")).applyInArrow(_solve_shard(length), _FIRST))
    pending = solved.where("text is not null")
    strings = pending.agg(F.sum(F.size("prints"))).first()[0] or 0
    done = solved.where("text is null").select("doc_id", "n_bytes", "begins", "finishes", "kept_sha256")
    ranges = max(1, -(-strings // RANGE_STRINGS))
    lists = pending.select("shard", "prints").groupBy("shard").applyInArrow(_deal_prints(ranges), "range int, shard int, prints binary")
    answers = settle(lists.groupBy("range").applyInArrow(_merge_range, "shard int, repeated binary"))
    rest = pending.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
        _finish(length), "doc_id long, n_bytes long, begins array<long>, finishes array<long>, kept_sha256 string")
    return done.union(rest)


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CAST(encode(coalesce(text, '')) AS BLOB) AS b FROM documents),
h AS (SELECT r, doc_id, hex(b) AS h, octet_length(b) AS n FROM d),
s AS (SELECT r, p, substr(h, 2 * p + 1, 400) AS g FROM (SELECT r, h, unnest(generate_series(0, n - 200)) AS p FROM h WHERE n >= 200)),
k AS (SELECT md5(g) AS m FROM s GROUP BY 1 HAVING count(*) > 1),
w AS (SELECT r, p FROM s WHERE md5(g) IN (SELECT m FROM k)),
e AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 200, true) AS fresh FROM w),
g AS (SELECT r, p, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM e),
t AS (SELECT r, k, min(p) AS b, max(p) + 200 AS f FROM g GROUP BY r, k),
q AS (SELECT t.r, b, f, h, n, coalesce(lag(f) OVER (PARTITION BY t.r ORDER BY b), 0) AS a,
    lead(b) OVER (PARTITION BY t.r ORDER BY b) IS NULL AS last FROM t JOIN h USING (r)),
x AS (SELECT r, CAST(sum(f - b) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * a + 1, 2 * (b - a))
    || CASE WHEN last THEN substr(h, 2 * f + 1) ELSE '' END, '' ORDER BY b) AS kept FROM q GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM h LEFT JOIN x USING (r)"""


@query("op2_repeated_strings", SQL)
def _(spark, d):
    found = find_repeats(read_table(spark, d, "documents"))
    size = F.aggregate(F.zip_with("begins", "finishes", lambda b, f: f - b), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("begins").cast("long").alias("n_spans"), "kept_sha256")
