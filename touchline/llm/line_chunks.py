"""Line dedup by content-defined chunks, in DataFrame operations only.

A polynomial rolling hash over the hashes of two neighbouring lines decides where a chunk ends, so an insertion moves
only the borders near it and a shared passage falls into the same chunks wherever it stands. Chunks of at least two
lines whose hash occurs more than once are candidates; their texts are grouped byte for byte, and every occurrence but
the first (smallest id, then place) is removed.

Only hashes of all chunks are counted, only candidates' texts are shuffled, and both are summed before they move, so a
chunk that a third of the documents share is one row per task. Documents meet their removed places by one join.

Defined cases: a null text is empty and has no lines; lines end at line feeds; rows that repeat both id and text are
one document that counts twice, so each keeps what the first keeps; a null id sorts first; empty lines are lines;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import read_table
from touchline.llm.registry import query
from touchline.session import settle

LEAST_LINES, MEAN_LINES = 2, 3
_BASE, _MODULUS = 1_000_003, 2_147_483_647


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "digest", F.xxhash64("text"))


def with_chunks(rows: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, digest, text, lines, chunks) of ``rows`` (doc_id, text, digest): chunks have first and last (line
    numbers from 0)."""
    lines = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1))
    # lambdas see only their own element: an outer array would be made anew for every element
    hashed = rows.withColumn("lines", lines).withColumn("hashes", F.transform("lines", _line_hash))
    shifted = F.slice(F.concat(F.array(F.lit(0).cast("long")), F.col("hashes")), 1, F.size("hashes"))
    rolled = F.zip_with(shifted, "hashes", lambda a, h: (a * _BASE + h) % _MODULUS)
    marked = F.filter(F.transform(rolled, lambda r, i: F.when(r % MEAN_LINES == 0, i)), lambda i: i.isNotNull())
    ended = hashed.withColumn("marks", marked).withColumn("ends", F.array_union("marks", F.when(
        F.size("lines") > 0, F.array(F.size("lines") - 1)).otherwise(F.array().cast("array<int>"))))
    firsts = F.slice(F.concat(F.array(F.lit(0)), F.transform("ends", lambda e: e + 1)), 1, F.size("ends"))
    chunks = F.zip_with(firsts, "ends", lambda a, e: F.struct(a.alias("first"), e.alias("last")))
    return ended.select("doc_id", "digest", "text", "lines", chunks.alias("chunks"), *carried)


def remove_repeated_chunks(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept_text, n_lines, n_chunks, n_removed (lines), n_spans (chunks removed)), one row per document."""
    rows = _rows(docs, doc_id, text)
    chunked = with_chunks(rows)
    own = F.array_join(F.slice("lines", F.col("c.first") + 1, F.col("c.last") - F.col("c.first") + 1), "\n")
    each = chunked.select("doc_id", "digest", "lines", F.explode("chunks").alias("c")).where(
        F.col("c.last") - F.col("c.first") + 1 >= LEAST_LINES).select(
        "doc_id", "digest", F.col("c.first").alias("first"), F.col("c.last").alias("last"), own.alias("chunk")).withColumn(
        "key", F.xxhash64("chunk"))
    spot = settle(each.select("key", "doc_id", "digest", "first", "last"))  # numbers alone, so lines are cut and hashed once for them
    repeated = settle(spot.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    place = F.struct("doc_id", "digest", "first")
    # both sides grow with the documents: a small one is not broadcast either, so that work grows in proportion
    groups = settle(each.join(repeated.hint("merge"), "key", "left_semi").groupBy("key", "chunk").agg(
        F.count("*").alias("n"), F.min(place).alias("keeper")))
    texts = groups.groupBy("key").agg(F.count("*").alias("texts"), F.max("n").alias("n"), F.first("keeper").alias("keeper"))
    alike = settle(texts.where("texts = 1 and n > 1").select("key", "keeper"))
    gone = spot.join(alike, "key").where(~F.col("keeper").eqNullSafe(place))
    clashing = settle(texts.where("texts > 1").select("key"))  # one hash, several texts
    by_text = groups.join(clashing, "key", "left_semi").where("n > 1").select("key", "chunk", "keeper")
    gone = gone.select("doc_id", "digest", "first", "last").union(
        each.join(clashing, "key", "left_semi").join(by_text, ["key", "chunk"]).where(
            ~F.col("keeper").eqNullSafe(place)).select("doc_id", "digest", "first", "last"))
    # a place once, however often its row is repeated
    per_doc = settle(gone.groupBy(F.col("doc_id").alias("_d"), F.col("digest").alias("_g")).agg(
        F.sort_array(F.collect_set(F.struct("first", "last"))).alias("gone")))
    # texts move without their lines, which are cut again behind the join
    joined = rows.join(per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("digest") == F.col("_g")), "left")
    removed = F.coalesce("gone", F.array().cast("array<struct<first:int,last:int>>"))
    out = with_chunks(joined.withColumn("gone", removed).drop("_d", "_g"), "gone")
    kept = F.filter("chunks", lambda c: ~F.array_contains("gone", c))
    parts = F.transform(kept, lambda c: F.array_join(F.slice("lines", c["first"] + 1, c["last"] - c["first"] + 1), "\n"))
    return out.select(
        "doc_id", F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(parts, "\n")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"), F.size("chunks").cast("long").alias("n_chunks"),
        F.aggregate("gone", F.lit(0).cast("long"), lambda a, c: a + c["last"] - c["first"] + 1).alias("n_removed"),
        F.size("gone").cast("long").alias("n_spans"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
l AS (SELECT r, doc_id, i - 1 AS i, lines[i] AS line FROM (SELECT r, doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM d)),
h AS (SELECT *, CAST('0x' || left(md5(line), 7) AS BIGINT) AS h FROM l),
b AS (SELECT *, (coalesce(lag(h) OVER (PARTITION BY r ORDER BY i), 0) * 1000003 + h) % 2147483647 % 3 = 0 AS ends FROM h),
c AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
k AS (SELECT r, doc_id, k, min(i) AS first, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY r, doc_id, k),
x AS (SELECT *, CASE WHEN n >= 2 THEN row_number() OVER (PARTITION BY n >= 2, chunk ORDER BY doc_id, first) ELSE 1 END > 1 AS gone FROM k),
g AS (SELECT r, count(*) AS n_chunks, sum(CASE WHEN gone THEN n ELSE 0 END) AS n_removed, count(*) FILTER (gone) AS n_spans,
    string_agg(chunk, chr(10) ORDER BY first) FILTER (NOT gone) AS kept FROM x GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_chunks, 0) AS BIGINT) AS n_chunks,
  CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)"""


@query("op9_line_chunks", SQL)
def _(spark, d):
    out = remove_repeated_chunks(read_table(spark, d, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "n_removed", "n_spans",
                      F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
