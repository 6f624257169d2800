"""Near duplicates: MinHash bands find candidates, odd sketches sort them out, full shingle sets confirm them.

1. One pass over the documents gives each text's shingle-set size, a 128-bit key of the set, 32 band keys of four
   MinHash samples each, and an odd sketch: 512 parity bits in which every sample flips one. The bits in which two
   sketches differ count the samples that differ, most precisely where few do, that is for high similarities.
2. Texts with equal sets form a class; only its smallest id goes on, so a group of copies is one row from here.
3. Each bucket (equal band key) pairs its members with its smallest one only. Each document is first held against the
   one that it meets in most buckets; then come the pairs that would still join components. Pairs whose sketches are
   too far apart drop, the others are confirmed.
4. Buckets that still hold several components compare members of different components inside tasks, block against
   block: sketches tell which may be linked, their full sets are compared there, and of the links found only those that
   join components come out. No candidate is lost or capped, and near misses never leave a task.

A pair at the threshold is missed by all bands with a probability below 1e-7 (0.8) or 1e-10 (0.85), and by the sketch limit
with 4e-10 or 6e-12 (worked out over the flips), so the bands decide.

Defined cases: a null or empty text, or one of white space, has an empty set and is linked with nothing; a row with a
null id is linked with nothing, has a null component and is kept; repeated rows are copies of each other; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import LOWER_BYTES, SPACED, mix64, read_table, shards, text_bytes, word_hashes, word_spans
from touchline.llm.components import connected_components
from touchline.llm.registry import query
from touchline.session import settle

BANDS, BAND_ROWS, SKETCH_BITS = 32, 4, 512
SAMPLES = BANDS * BAND_ROWS
SKETCH_WORDS = SKETCH_BITS // 64
#: How far below the threshold a similarity estimated from sketches may lie.
SLACK = 0.28
BLOCK = 512
#: Shingles that are compared at a time.
CHUNK = 4096
SHARD_BYTES, SHARD_ROWS = 2 << 20, 1024
_KEYS = mix64(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_FLIP, _ODD = _KEYS[:SAMPLES].astype(np.uint32), (_KEYS[SAMPLES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (54 bits) of all rows (at most ``SHARD_ROWS``), sorted within rows; offsets of the rows."""
    data, offsets = text_bytes(texts)
    n_rows = len(offsets) - 1
    low = LOWER_BYTES[data]
    begins, finishes, rows = word_spans(low, offsets, SPACED)
    words = word_hashes(low, begins, finishes)
    counts = np.bincount(rows, minlength=n_rows)
    value = np.zeros(len(words), np.uint64)
    for k in range(width):  # a text of fewer words is one shingle of all its words
        ahead = np.arange(len(words)) + k
        fits = ahead < len(words)
        same = np.zeros(len(words), bool)
        same[fits] = rows[ahead[fits]] == rows[fits]
        part = np.where(same, words[np.minimum(ahead, max(0, len(words) - 1))], np.uint64(0))
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + part + same.astype(np.uint64))
    first = np.cumsum(counts) - counts
    keep = np.arange(len(words)) - first[rows] <= np.maximum(counts - width, 0)[rows]
    packed = np.unique((rows[keep].astype(np.uint64) << np.uint64(54)) | (value[keep] >> np.uint64(10)))
    of = (packed >> np.uint64(54)).astype(np.int64)
    edges = np.searchsorted(of, np.arange(n_rows + 1))
    return packed & np.uint64((1 << 54) - 1), edges


def _small(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    for table in shards(batches, column, SHARD_BYTES):
        for k in range(0, table.num_rows, SHARD_ROWS):
            yield table.slice(k, SHARD_ROWS)


def signatures(sets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows x BANDS) and odd sketches (rows x SKETCH_WORDS) of non-empty sets."""
    n = len(edges) - 1
    bands, sketches = np.zeros((n, BANDS), np.uint64), np.zeros((n, SKETCH_BITS), np.uint8)
    if not n:
        return bands, np.zeros((0, SKETCH_WORDS), np.uint64)
    base = (sets >> np.uint64(11)).astype(np.uint32)
    for i in range(SAMPLES):
        sample = np.minimum.reduceat((base ^ _FLIP[i]) * _ODD[i], edges[:-1]).astype(np.uint64)
        mixed = mix64(sample + (np.uint64(i + 1) << np.uint64(32)))
        bands[:, i // BAND_ROWS] = mix64(bands[:, i // BAND_ROWS] + mixed)
        sketches[np.arange(n), (mixed % np.uint64(SKETCH_BITS)).astype(np.int64)] ^= 1
    return bands, np.packbits(sketches, axis=1).view(np.uint64)


_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
_SIGNED = ("id long, n_shingles long, k1 long, k2 long, bands array<long>, " + ", ".join(f"{c} long" for c in _SKETCH))


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _small(batches, "text"):
            sets, edges = shingle_sets(table["text"], width)
            sizes = np.diff(edges)
            held = np.flatnonzero(sizes)
            bands, sketches = signatures(sets, np.append(edges[:-1][held], len(sets)))
            k1, k2 = np.zeros((2, len(sizes)), np.uint64)
            if len(held):
                k1[held] = np.add.reduceat(mix64(sets), edges[:-1][held])
                k2[held] = np.bitwise_xor.reduceat(mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), edges[:-1][held])
            wide = np.zeros((len(sizes), SKETCH_WORDS), np.uint64)
            wide[held] = sketches
            per = np.where(sizes > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)),
                                             pa.array(bands.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [table["id"].combine_chunks() if table["id"].num_chunks == 1 else pa.concat_arrays(table["id"].chunks),
                 pa.array(sizes.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists,
                 *(pa.array(wide[:, i].copy().view(np.int64)) for i in range(SKETCH_WORDS))],
                ["id", "n_shingles", "k1", "k2", "bands", *_SKETCH])
    return run


def _most_bits(percent: int) -> int:
    """The largest number of differing sketch bits that a pair may show and still be confirmed."""
    differing = 2 * SAMPLES * (1 - (percent / 100 - SLACK))
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-2 * differing / SKETCH_BITS))))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _small(batches, "text"):
            sets, edges = shingle_sets(table["text"], width)
            raw = [sets[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(table["id"].chunks), pa.array(raw, pa.binary())], ["id", "set"])
    return run


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    ids = settle(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())

    sets = settle(texts.join(ids, "id", "left_semi").mapInArrow(_sets(width), "id long, set binary"))
    beside = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return settle(beside.mapInArrow(linked, "a long, b long"))


def _common(left: list, right: list) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by products over the shingles that both sides hold."""
    of = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    held = [np.concatenate(side) for side in (left, right)]
    codes = np.intersect1d(*held)
    counts = np.zeros((len(left), len(right)), np.float32)  # exact: sets have far fewer than 2 ** 24 shingles in a chunk
    total = np.zeros(counts.shape, np.int64)
    places = [np.searchsorted(codes, h) for h in held]
    known = [np.flatnonzero((p < len(codes)) & (codes[np.minimum(p, len(codes) - 1)] == h)) if len(codes) else np.zeros(0, np.int64)
             for p, h in zip(places, held)]
    sides = []
    for p, k, o in zip(places, known, of):
        order = k[np.argsort(p[k], kind="stable")]
        sides.append((p[order], o[order]))
    for begin in range(0, len(codes), CHUNK):
        made = []
        for (place, row), side in zip(sides, (left, right)):
            x, y = np.searchsorted(place, [begin, begin + CHUNK])
            dense = np.zeros((len(side), min(CHUNK, len(codes) - begin)), np.float32)
            dense[row[x:y], place[x:y] - begin] = 1
            made.append(dense)
        np.matmul(made[0], made[1].T, out=counts)
        total += counts.astype(np.int64)
    return total


def _forest(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the links (x, y) join two of the components that the labels ``a`` and ``b`` and the links before make."""
    above: dict = {}

    def root(v: int) -> int:
        while v in above:
            v = above[v]
        return v

    keep = np.zeros(len(x), bool)
    for k, (p, q) in enumerate(zip(a[x].tolist(), b[y].tolist())):
        p, q = root(p), root(q)
        if p != q:
            above[max(p, q)] = min(p, q)
            keep[k] = True
    return keep


def _linked_blocks(limit: int, percent: int):
    """Rows sorted by (bucket, i, j): links between a bucket's blocks i and j that join components.

    Sketches tell which members may have a link; the sets of these are compared in full, and of the links found only
    those come out that join two components, fewer than there are members.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def flush():
            table = pa.Table.from_batches(held)
            block, i, j = (table[c].to_numpy() for c in ("block", "i", "j"))
            ids, label = table["id"].to_numpy(), table["label"].to_numpy()
            sketch = np.stack([table[c].to_numpy().view(np.uint64) for c in _SKETCH], 1)
            left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
            near = np.zeros((len(left), len(right)), bool)
            for start in range(0, len(left), 128):
                rows = left[start:start + 128]
                apart = np.bitwise_count(sketch[rows][:, None, :] ^ sketch[right][None, :, :]).sum(2, dtype=np.int32)
                near[start:start + 128] = (apart <= limit) & (label[rows][:, None] != label[right][None, :])
            left, right = left[near.any(1)], right[near.any(0)]
            if not len(left):
                return
            sets = table["set"]
            get = lambda rows: [np.frombuffer(sets[int(r)].as_buffer(), np.uint64) for r in rows]
            for start in range(0, len(left), BLOCK):
                for other in range(0, len(right), BLOCK):
                    rows, columns = left[start:start + BLOCK], right[other:other + BLOCK]
                    mine, theirs = get(rows), get(columns)
                    sizes = np.array([len(m) for m in mine])[:, None] + np.array([len(m) for m in theirs])[None, :]
                    common = _common(mine, theirs)
                    x, y = np.nonzero((100 * common >= percent * (sizes - common)) & (label[rows][:, None] != label[columns][None, :]))
                    keep = _forest(label[rows], label[columns], x, y)
                    x, y = ids[rows[x[keep]]], ids[columns[y[keep]]]
                    yield pa.RecordBatch.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)})

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:]):
                own = tuple(cols[x].tolist())
                if held and own != key:
                    yield from flush()
                    held = []
                held.append(batch.slice(x, y - x))
                key = own
        if held:
            yield from flush()
    return run


def _block_pairs(members: DataFrame) -> DataFrame:
    """(bucket, id, label, block, i, j): each member once for each pair of blocks that it takes part in.

    A component of a bucket with at least ``BLOCK`` members has blocks of its own, which never meet each other; the rest
    share blocks. So a large group beside a few strangers is read once, and only the strangers are copied.
    """
    sizes = settle(members.groupBy("bucket", "label").agg(F.count("*").alias("m")))
    large = F.col("m") >= BLOCK
    shared = sizes.groupBy("bucket").agg(F.sum(F.when(~large, F.col("m")).otherwise(0)).alias("rest"),
                                         F.sum(F.when(large, F.ceil(F.col("m") / BLOCK)).otherwise(0)).alias("own"))
    shared = shared.select("bucket", F.ceil(F.col("rest") / BLOCK).cast("int").alias("mixed"), F.col("own").cast("int").alias("own"))
    many = F.ceil(F.col("m") / BLOCK).cast("int")
    before = F.sum(many).over(Window.partitionBy("bucket").orderBy("label").rowsBetween(Window.unboundedPreceding, -1))
    # large components of a bucket: one row for BLOCK members at most
    big = sizes.where(large).select("bucket", "label", many.alias("many"), F.coalesce(before, F.lit(0)).cast("int").alias("before"))
    placed = members.join(settle(shared), "bucket").join(settle(big), ["bucket", "label"], "left")
    spread = F.pmod(F.xxhash64("id"), F.coalesce("many", F.greatest("mixed", F.lit(1)))).cast("int")
    low = F.col("mixed") + F.col("before")
    every = F.sequence(F.lit(0), F.col("mixed") + F.col("own") - 1)
    others = F.when(F.col("many").isNull(), every).otherwise(F.filter(every, lambda k: (k < low) | (k >= low + F.col("many"))))
    return placed.withColumn("block", F.when(F.col("many").isNull(), spread).otherwise(low + spread)).withColumn("other", F.explode(others)).select(
        "bucket", "id", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3,
                    percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): links are pairs with 100 * intersection >= percent * union."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signed = settle(texts.mapInArrow(_sign(width), _SIGNED))
    real = signed.where("id is not null and n_shingles > 0")
    key = ["k1", "k2", "n_shingles"]
    classes = settle(real.groupBy(*key).agg(F.min("id").alias("rep")))
    # the smallest id of a class stands for it; rows that repeat the id bring the same bands
    heads = settle(real.join(classes.select(*key, F.col("rep").alias("id")), [*key, "id"], "left_semi").dropDuplicates(["id", *key]))
    band_rows = settle(heads.select("id", F.explode("bands").alias("bucket")).distinct())
    most = _most_bits(percent)
    leaders = settle(band_rows.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1"))
    sketch = settle(heads.dropDuplicates(["id"]).select("id", F.col("n_shingles").alias("size"), *_SKETCH))
    stars = settle(band_rows.join(leaders, "bucket").where("a < id").groupBy("a", F.col("id").alias("b")).agg(
        F.count("*").alias("shared")))
    held = texts.where("id is not null")
    far = sketch.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in _SKETCH])
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_a"))) for c in _SKETCH])

    def close(pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches are near enough to be confirmed."""
        return settle(pairs.join(sketch.withColumnRenamed("id", "b").drop("size"), "b").join(far, "a").where(
            apart <= most).select("a", "b"))

    # of its buckets' smallest members, each document is held against the one it meets most often
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    links = _confirm(close(best), held, width, percent)
    labels = connected_components(links)

    def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs that would still join components."""
        for c in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left")
        return pairs.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")

    more = close(settle(across(stars.select("a", "b"), labels)))
    if not more.isEmpty():
        links = links.union(_confirm(more, held, width, percent))
        labels = connected_components(links)
    # buckets with several components: every pair of their blocks inside a task
    placed = band_rows.join(leaders.select("bucket", "n"), "bucket").join(
        labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = settle(placed.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket"))
    members = settle(placed.join(mixed, "bucket", "left_semi"))
    wanted = settle(members.select("id").distinct())
    sets = settle(held.join(wanted, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(width), "id long, set binary"))
    dealt = _block_pairs(members.select("bucket", "id", "label")).join(
        settle(sketch.join(sets, "id").select("id", "set", *_SKETCH)), "id")
    together = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    last = settle(together.mapInArrow(_linked_blocks(most, percent), "a long, b long"))
    if not last.isEmpty():
        links = links.select("a", "b").union(last)
        labels = connected_components(links)
    rep_label = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select(
        *key, F.coalesce("label", "rep").alias("component_id"))
    out = signed.select("id", *key).join(settle(rep_label), key, "left").select(
        F.col("id").alias("doc_id"), "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5,
                         percent: int = 80) -> DataFrame:
    """One document of each group, that with the smallest id, with the columns of ``docs``; rows that repeat an id and
    its text stay once."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    own, body = (names[docs.columns.index(c)] for c in (doc_id, text))
    found = near_duplicates(rows, doc_id=own, text=body, width=width, percent=percent)
    gone = settle(found.where("not kept").select(F.col("doc_id").alias("_d")).distinct())
    left = rows.join(gone, F.col(own) == F.col("_d"), "left_anti")
    again = settle(rows.where(F.col(own).isNotNull()).groupBy(F.col(own).alias("_d")).count().where("count > 1").select("_d"))
    if not again.isEmpty():
        left = left.join(again, F.col(own) == F.col("_d"), "left_anti").union(
            left.join(again, F.col(own) == F.col("_d"), "left_semi").dropDuplicates([own, body]))
    return left.toDF(*docs.columns)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS p FROM w WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, label FROM r JOIN both_ways ON a = node),
m AS (SELECT node, min(label) AS label FROM r GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, label AS component_id, doc_id = label AS kept
FROM documents LEFT JOIN z USING (doc_id) JOIN m ON node = doc_id"""


@query("op1_near_duplicates", SQL)
def _(spark, d):
    return near_duplicates(read_table(spark, d, "documents"))
