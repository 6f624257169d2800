"""License scan with a positional rare-token index, in DataFrame operations only.

Files keep only their licence words, with positions. The index maps each licence word to the places where notices hold
it. The rarest word of each notice's key phrase (highest inverse document frequency over all files, function words
excluded) is its anchor: each place of an anchor in a file votes for the notice at an offset. Files with a vote have
all their licence words aligned: the score of (notice, offset) is the share of the notice's weight found at the right
relative positions, and the notice's key phrase must stand there word for word. A notice without its anchor lacks its
key phrase, so no vote misses one, however many notices a file holds. Base phrases are found as consecutive words.

Postings are a constant of this module. Votes and alignments are sums by (file, notice, offset), so neither a very
long file nor a notice in a third of all files makes a hot group.

Defined cases: a null or empty text has no words and no labels, and a score of 0; repeated rows are scanned row by row;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import lower_ascii, read_table
from touchline.llm.registry import query
from touchline.session import settle

#: Base phrases and their labels: fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices (label, words, key phrase that must be present).
NOTICES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "public domain under cc0"),
]
#: Words that say nothing by themselves.
FUNCTION_WORDS = {"a", "and", "any", "are", "by", "in", "is", "of", "or", "the", "this", "to", "under", "use", "with"}
LEAST_SHARE = 0.6

_WORDS = sorted({w for text in [*BASE, *(n[1] for n in NOTICES)] for w in text.split()})


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def licence_words(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, doc_id, n_words, hits): positions of the words that any notice or phrase holds."""
    split = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(_WORDS), F.struct(i.alias("p"), w.alias("w")))),
                    lambda h: h.isNotNull())
    return split.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits")).withColumn(
        "id", F.monotonically_increasing_id())


def _places(phrase: str) -> Column:
    """Starts of the phrase: its words are all licence words, so they are neighbours among the hits, too."""
    words = phrase.split()
    zipped = F.arrays_zip(*[F.slice("hits", k + 1, F.greatest(F.size("hits"), F.lit(1))).alias(f"h{k}") for k in range(len(words))])

    def stands(z: Column) -> Column:
        fits = z["h0"]["w"] == words[0]
        for k, word in enumerate(words[1:], 1):
            fits &= (z[f"h{k}"]["w"] == word) & (z[f"h{k}"]["p"] == z["h0"]["p"] + k)
        return fits

    return F.transform(F.filter(zipped, stands), lambda z: z["h0"]["p"])


def postings(spark) -> DataFrame:
    """(w, notice, j, label, in_key): every word of every notice, a constant of some hundred rows."""
    rows = []
    for t, (label, text, key) in enumerate(NOTICES):
        words, wanted = text.split(), key.split()
        start = next(i for i in range(len(words)) if words[i:i + len(wanted)] == wanted)
        rows += [(w, t, j, label, start <= j < start + len(wanted)) for j, w in enumerate(words)]
    return spark.createDataFrame(rows, "w string, notice int, j int, label string, in_key boolean")


def _anchors(idf: dict[str, float]) -> list[tuple[str, int, int]]:
    """(w, notice, j): the rarest content word of each notice's key phrase, and its place in the notice."""
    rows = []
    for t, (_, text, key) in enumerate(NOTICES):
        words, wanted = text.split(), key.split()
        start = next(i for i in range(len(words)) if words[i:i + len(wanted)] == wanted)
        k = min((k for k, w in enumerate(wanted) if w not in FUNCTION_WORDS), key=lambda k: (-idf[wanted[k]], wanted[k], k))
        rows.append((wanted[k], t, start + k))
    return rows


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, base_places, base_labels, notices): ``notices`` lists (label, start, share) of the found ones."""
    spark = docs.sparkSession
    files = settle(licence_words(docs, doc_id, text))
    index = postings(spark)
    content = [w for w in _WORDS if w not in FUNCTION_WORDS]
    present = files.select("id", F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).where(
        F.col("w").isin(content))
    n = files.count()
    seen = {r.w: r.df for r in present.groupBy("w").agg(F.count("*").alias("df")).collect()}  # a row for each licence word
    idf = {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1 for w in content} | {w: 0.1 for w in FUNCTION_WORDS}
    weight = F.create_map(*[F.lit(x) for w in _WORDS for x in (w, idf[w])])
    anchors = _anchors(idf)
    anchored = F.filter("hits", lambda h: h["w"].isin([w for w, *_ in anchors]))
    looked = files.select("id", F.explode(anchored).alias("h")).select("id", F.col("h.p").alias("p"), F.col("h.w").alias("w"))
    places = F.broadcast(spark.createDataFrame(anchors, "w string, notice int, j int"))
    votes = looked.join(places, "w").select("id", "notice", (F.col("p") - F.col("j")).alias("offset"))
    voted = settle(votes)  # a place once: a notice has one anchor
    of_file = files.join(voted.select("id").distinct(), "id", "left_semi").select("id", F.explode("hits").alias("h"))
    aligned = of_file.select("id", F.col("h.p").alias("p"), F.col("h.w").alias("w")).join(F.broadcast(index), "w").groupBy(
        "id", "notice", "label", (F.col("p") - F.col("j")).alias("offset")).agg(
        F.sum(weight[F.col("w")]).alias("found"), F.sum(F.col("in_key").cast("int")).alias("key_words"))
    whole = {t: (sum(idf[w] for w in text.split()), len(key.split())) for t, (_, text, key) in enumerate(NOTICES)}
    total = F.create_map(*[F.lit(x) for t, (s, _) in whole.items() for x in (t, s)])
    needed = F.create_map(*[F.lit(x) for t, (_, k) in whole.items() for x in (t, k)])
    share = F.least(F.lit(1.0), F.round(F.col("found") / total[F.col("notice")], 9))
    found = aligned.join(voted, ["id", "notice", "offset"], "left_semi").withColumn("share", share).where(
        (F.col("key_words") == needed[F.col("notice")]) & (F.col("share") >= LEAST_SHARE))
    notices = settle(found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(
        "label", F.col("offset").alias("start"), "share"))).alias("notices")))
    base = {label: _places(phrase) for phrase, label in BASE.items()}
    places = files.select("id", "doc_id", "n_words", *[c.alias(f"b{k}") for k, c in enumerate(base.values())])
    labels = F.array_compact(F.array(*[F.when(F.size(f"b{k}") > 0, F.lit(label)) for k, label in enumerate(base)]))
    return places.join(notices, "id", "left").select(
        "doc_id", "n_words", F.concat(*[F.col(f"b{k}") for k in range(len(base))]).alias("base_places"),
        labels.alias("base_labels"), F.coalesce("notices", F.array().cast(
            "array<struct<label:string,start:int,share:double>>")).alias("notices"))


@query("op5_license_scan")
def _(spark, d):
    found = scan_licenses(read_table(spark, d, "documents"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    method = F.transform("notices", lambda x: x["label"])
    score = F.when(F.size("base_labels") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("notices", lambda x: x["share"])), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min("base_places").cast("long").alias("first_word"),
        F.array_max("base_places").cast("long").alias("last_word"), joined(F.col("base_labels")).alias("base_labels"),
        joined(F.concat("base_labels", method)).alias("labels"), score.alias("score"))
