"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Targets: every source asks for its weight's share of all words; one that would pass its cap gives the excess to the
   others by weight. With sources ordered by cap / weight this is one running sum (water filling), no iteration.
2. A source's documents are put in an order drawn by a hash. A target of f times the source is floor(f) whole passes
   and a last pass that stops where the words come nearest to the target. Running sums come from two levels (slices of
   the hash space, then rows of a slice), so a source of any size is never one sorted group.
3. Every pass is cut into blocks of about ``block_words`` words. Quotas are exact block counts of the sources. A tree
   halves them again and again: the left child takes half of its parent's blocks, and how many come from each source
   is drawn from the multivariate hypergeometric distribution, source by source, within 12 standard deviations. Leaves are the output shards.
4. A source's blocks, in an order drawn anew, are dealt to the shards by the running sums of the quotas, and each
   shard's documents get a random place. Shards need no exchange with each other.

All draws are hashes of the seed, so reruns agree. Tables of sources, quotas and slices are small aggregates.

Defined cases: a null or empty text has size 0 and is never needed (taken 0); a null source is a source of its own,
last in order; a null id is ordered by its text's hash; repeated rows are drawn apart by row hash and count; a table
without any words takes nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import read_table
from touchline.llm.registry import query
from touchline.session import settle

CAP = 3
BLOCK_WORDS = 20_000
SHARD_LEVELS = 4  # 16 output shards
SLICE_ROWS = 500


def count_words(text: Column) -> Column:
    """Maximal runs of anything but space and tab to carriage return."""
    parts = F.size(F.split(text, r"[\x20\x09-\x0D]+"))
    blank = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]$"), 1).otherwise(0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).when(
        text.rlike(r"^[\x20\x09-\x0D]+$"), 0).otherwise(parts - blank).cast("long")


def source_targets(sized: DataFrame, weights: int, share: float, cap: float) -> DataFrame:
    """(source, src, source_size, n_rows, target): one row per source, numbered from 0 in code-point order, null last;
    weights 1, 2, ... ``weights`` repeat in that order."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    one = Window.partitionBy(F.lit(0))
    ordered = one.orderBy(F.col("source").isNull(), F.col("source"))  # one row per source
    weighed = per.withColumn("src", F.row_number().over(ordered) - 1).withColumn("weight", F.col("src") % weights + 1)
    by_room = one.orderBy(F.col("source_size") / F.col("weight"), "src")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(one) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    # the level that this source and all with more room would share, were all with less room full
    level = left / F.sum("weight").over(after)
    full = level * F.col("weight") > cap * F.col("source_size")
    leveled = weighed.withColumn("level", level).withColumn("full", full)
    first = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "src", F.col("level").alias("level")))).over(one)["level"]
    return leveled.withColumn("shared", first).select(
        "source", "src", "source_size", "n_rows",
        F.when(F.col("full"), F.lit(cap) * F.col("source_size")).otherwise(F.col("shared") * F.col("weight")).cast("double").alias("target"))


def _position(*parts: Column) -> Column:
    """A hash of the parts, from 0 to below 2**60."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def running_sum(rows: DataFrame, n_rows: Column) -> DataFrame:
    """``rows`` (src, place, tie, size) with ``before``, the sizes of the source's rows at smaller places, and with
    ``slice`` and ``nth``, which name the row within its source; ``n_rows``: rows of the source."""
    slices = F.greatest(F.lit(1), F.ceil(n_rows / SLICE_ROWS)).cast("long")
    cut = rows.withColumn("slice", F.floor(F.col("place") / F.lit(float(1 << 60)) * slices).cast("long"))
    per_slice = settle(cut.groupBy("src", "slice").agg(F.sum("size").alias("words")))
    until = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(per_slice.select("src", "slice", F.coalesce(F.sum("words").over(until), F.lit(0)).alias("start")))
    inside = Window.partitionBy("src", "slice").orderBy("place", "tie")
    placed = cut.withColumn("nth", F.row_number().over(inside)).withColumn(
        "within", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(starts, ["src", "slice"]).withColumn("before", F.col("start") + F.col("within")).drop("start", "within")


def _hypergeometric(total: Column, marked: Column, drawn: Column, *seeds: Column) -> Column:
    """How many of ``drawn`` among ``total`` are of the ``marked``.

    One pass over the values around the mean: the logarithm of the probability follows by ratios, and the value whose
    logarithm plus Gumbel noise is largest is a draw from the distribution. Noise is a hash of the seeds and the value.
    """
    mean = drawn * marked / F.greatest(total, F.lit(1))
    spread = F.sqrt(F.greatest(mean * (1 - marked / F.greatest(total, F.lit(1))), F.lit(0.0))) * 12 + 12
    low = F.greatest(F.lit(0), drawn - (total - marked), F.floor(mean - spread)).cast("long")
    high = F.least(drawn, marked, F.ceil(mean + spread)).cast("long")

    def step(state: Column, k: Column) -> Column:
        ratio = ((marked - k + 1) * (drawn - k + 1)).cast("double") / (k * (total - marked - drawn + k))
        log = F.when(state["k"].isNull(), F.lit(0.0)).otherwise(state["log"] + F.log(ratio))
        u = (F.pmod(F.xxhash64(*seeds, k), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        noisy = log - F.log(-F.log(u))
        better = state["k"].isNull() | (noisy > state["top"])
        return F.struct(log.alias("log"), F.when(better, noisy).otherwise(state["top"]).alias("top"),
                        F.when(better, k).otherwise(state["k"]).alias("k"))

    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("top"), F.lit(None).cast("long").alias("k"))
    return F.aggregate(F.sequence(low, F.greatest(low, high)), start, step)["k"]


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(src, shard, quota): ``quotas`` (src, blocks) dealt to ``2 ** levels`` shards by the splitting tree."""
    listed = quotas.agg(F.array_sort(F.collect_list(F.struct("src", "blocks"))).alias("rest"))  # one entry per source
    nodes = listed.select(F.lit(0).alias("node"), "rest").where(F.size("rest") > 0)
    for level in range(levels):
        total = F.aggregate("rest", F.lit(0).cast("long"), lambda a, x: a + x["blocks"])
        nodes = nodes.withColumn("total", total)
        half = F.floor((F.col("total") + F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node")), F.lit(2))) / 2).cast("long")
        nodes = nodes.withColumn("half", half)

        nodes = nodes.withColumn("level", F.lit(level))

        def draw(state, x):
            drawn = _hypergeometric(state["total"], x["blocks"], state["half"], F.lit(seed), F.col("level"), F.col("node"), x["src"])
            # through an array of one, so that the draw is made once
            return F.transform(F.array(drawn), lambda k: F.struct(
                (state["total"] - x["blocks"]).alias("total"), (state["half"] - k).alias("half"),
                F.concat(state["drawn"], F.array(k)).alias("drawn")))[0]

        start = F.struct(F.col("total"), F.col("half"), F.array().cast("array<bigint>").alias("drawn"))
        drawn = settle(nodes.withColumn("drawn", F.aggregate("rest", start, draw)["drawn"]))
        left = F.zip_with("rest", "drawn", lambda x, k: F.struct(x["src"].alias("src"), k.alias("blocks")))
        right = F.zip_with("rest", "drawn", lambda x, k: F.struct(x["src"].alias("src"), (x["blocks"] - k).alias("blocks")))
        nodes = drawn.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("rest")), F.struct(
            (F.col("node") * 2 + 1).alias("node"), right.alias("rest")))).alias("x")).select("x.*")
    return nodes.select(F.col("node").alias("shard"), F.inline("rest")).select("src", "shard", F.col("blocks").alias("quota"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: int = 3,
        share: float = 1.0, cap: int = CAP, block_words: int = BLOCK_WORDS, levels: int = SHARD_LEVELS,
        seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(taken, draws), both with the row's name (src, slice, nth) and doc_id: ``taken`` has every row with its size,
    digest, target and copies, ``draws`` one row for each time it is drawn (pass, shard and place in the shard)."""
    sized = settle(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), count_words(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("digest")))
    targets = settle(source_targets(sized, weights, share, cap).withColumnRenamed("source", "_s"))
    wide = sized.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = wide.withColumn("tie", F.concat_ws("|", name, "digest")).withColumn("place", _position(
        F.lit(str(seed)), name, F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise("")))
    ordered = running_sum(keyed, F.col("n_rows"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - passes * F.col("source_size")
    extra = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= rest)
    copies = F.when(F.col("size") > 0, F.least(F.lit(cap), passes + extra.cast("int"))).otherwise(0).cast("int")
    taken = settle(ordered.withColumn("copies", copies).drop("tie", "place", "n_rows"))
    # every pass over a source is cut into blocks
    draws = taken.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn(
        "block", F.floor(F.col("before") / block_words).cast("long")).select("doc_id", "digest", "source", "src", "slice", "nth", "pass", "block")
    blocks = settle(draws.select("src", "pass", "block").distinct().withColumn("size", F.lit(1).cast("long")).withColumn(
        "place", _position(F.lit(f"{seed}b"), F.col("src"), F.col("pass"), F.col("block"))).withColumn(
        "tie", F.struct("pass", "block")))
    counts = settle(blocks.groupBy("src").agg(F.count("*").alias("blocks")))
    quotas = split_quotas(counts, levels, seed)
    until = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = quotas.withColumn("end", F.sum("quota").over(until)).groupBy("src").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    turned = running_sum(blocks.join(counts, "src"), F.col("blocks"))
    dealt = settle(turned.join(settle(ends), "src").select(
        "src", "pass", "block", F.size(F.filter("ends", lambda e: e <= F.col("before"))).alias("shard")))
    placed = draws.join(dealt, ["src", "pass", "block"])
    return taken, placed.withColumn("place", F.xxhash64(F.lit(seed), "shard", "pass", "doc_id", "digest")).drop("block")


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix draws them, with the columns of ``docs``, shard by shard and in the order of
    their places; a partition is a stretch of that order, so a shard is not bound to one task."""
    taken, draws = mix(docs, doc_id=doc_id, text=text, source=source, **options)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {n: names[docs.columns.index(n)] for n in (doc_id, text, source)}
    rows = docs.toDF(*names).withColumn("_g", F.md5(F.coalesce(F.col(at[text]), F.lit("")).cast("binary")))
    key = [at[doc_id], "_g", at[source]]
    drawn = draws.select(F.col("doc_id").alias("_d"), F.col("digest").alias("_h"), F.col("source").alias("_s"), "shard", "place")
    if not taken.groupBy("doc_id", "digest", "source").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(key)  # repeated rows are drawn one by one; each draw finds the one row that is left
    same = F.col(key[0]).eqNullSafe(F.col("_d")) & (F.col("_g") == F.col("_h")) & F.col(key[2]).eqNullSafe(F.col("_s"))
    return rows.join(drawn, same).orderBy("shard", "place", "_s").select(*names).toDF(*docs.columns)


def mixed_digest(docs: DataFrame) -> DataFrame:
    """One row per document with the words that the draws take of it."""
    taken, draws = mix(docs)
    row = ["src", "slice", "nth"]
    drawn = draws.groupBy(*row).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("shard")).alias("shards"))
    return taken.join(drawn, row, "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.coalesce("n", F.lit(0))).cast("long").alias("taken"))


SQL = r"""
WITH s AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''),
    '[ 	-
]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM s GROUP BY source),
w AS (SELECT *, src % 3 + 1 AS weight FROM p),
l AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, src
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY source_size / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM w),
f AS (SELECT *, level * weight > 3 * source_size AS full_ FROM l),
t AS (SELECT source, source_size, CAST(CASE WHEN full_ THEN 3 * source_size ELSE
    (SELECT level FROM f g WHERE NOT full_ ORDER BY source_size / weight, src LIMIT 1) * weight END AS DOUBLE) AS target FROM f),
o AS (SELECT s.doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY
      left(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CASE WHEN doc_id IS NULL THEN digest ELSE '' END), 15),
      coalesce(CAST(doc_id AS VARCHAR), '') || '|' || digest
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE size * least(3, floor(target / source_size)
  + CASE WHEN before + size / 2 <= target - floor(target / source_size) * source_size THEN 1 ELSE 0 END) END AS BIGINT) AS taken
FROM o"""


@query("op4_mix_sources", SQL)
def _(spark, d):
    return mixed_digest(read_table(spark, d, "documents"))
