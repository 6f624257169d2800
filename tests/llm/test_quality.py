"""The quality classifier: features against plain Python, tables against brute force, held-out rows, defined cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import quality
from touchline.llm.quality import FEATURES


def plain_features(text):
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, w = max(len(data), 1), max(len(words), 1)
    kinds = {k: sum(b in set(v) for b in data) for k, v in quality._KINDS.items()}
    lines = [line.split() for line in re.split(rb"[\n\r]", re.sub(rb"[\x0B\x0C]", b" ", data))]
    lines = [line[0] for line in lines if line]
    caps = [x for x in words if sum(65 <= b < 91 for b in x) > 1 and not any(97 <= b < 123 for b in x)]
    odd = set(b"!?#$%&*@^~+=<>\\_`")
    out = {"log_bytes": np.log1p(len(data)), "log_words": np.log1p(len(words)), "mean_word": sum(map(len, words)) / w,
           "longest_word": np.log1p(max(map(len, words), default=0)), **{f"{k}_share": v / n for k, v in kinds.items()},
           "upper_of_letters": kinds["upper"] / max(kinds["upper"] + kinds["lower"], 1), "long_rate": sum(len(x) > 24 for x in words) / w,
           "caps_rate": len(caps) / w, "capital_rate": sum(65 <= x[0] < 91 and x not in caps for x in words) / w,
           "odd_end_rate": sum(x[-1] in odd for x in words) / w, "as_before_rate": sum(a == b for a, b in zip(words, words[1:])) / w,
           "as_two_before_rate": sum(a == b for a, b in zip(words, words[2:])) / w, "line_starts_rate": len(lines) / w,
           "line_as_before_rate": sum(a == b for a, b in zip(lines, lines[1:])) / w, "distinct_rate": len(set(words)) / w}
    return [out[f] for f in FEATURES]


def some_text(rng, junk):
    words = [rng.choice(["the", "house", "river", "Anna", "walks", "ÄÖ", "12", "blue."]) for _ in range(rng.randint(5, 80))]
    if junk == 1:
        words = [x + rng.choice(["%%%", "!!"]) for x in words]
    elif junk == 2:
        words = [words[0]] * len(words)
    return rng.choice([" ", "\n"]).join(words)


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_features_match_plain_python(monkeypatch, odd_docs, piece):
    monkeypatch.setattr(quality, "SHARD_BYTES", piece)
    rng = random.Random(4)
    texts = [r.text for r in odd_docs.collect()] + [some_text(rng, k % 3) for k in range(60)] + [" lead\n\nlead\r\nlead  A!", "B\x0bB\x0cC"]
    got = quality.features(pa.array(texts))
    assert np.allclose(got, [plain_features(t) for t in texts], rtol=1e-5, atol=1e-6)
    assert quality.features(pa.array([], pa.string())).shape == (0, len(FEATURES))


def test_a_tree_takes_the_best_cuts():
    rng = np.random.default_rng(5)
    g, h, n = rng.normal(size=12), rng.uniform(5, 9, 12), np.full(12, 50)
    step = quality.grow(g, h, n)
    assert 2 <= len(np.unique(step)) <= quality.LEAVES

    def worth(a, b):
        return g[a:b].sum() ** 2 / (h[a:b].sum() + quality.PENALTY)

    first = max(range(1, 12), key=lambda k: worth(0, k) + worth(k, 12))
    assert step[first - 1] != step[first]
    g2, h2, n2 = rng.normal(size=(5, 4)), rng.uniform(5, 9, (5, 4)), np.full((5, 4), 50)

    def four(i, j):
        parts = [(slice(a, b), slice(c, d)) for a, b in ((0, i), (i, 5)) for c, d in ((0, j), (j, 4))]
        return sum(g2[p].sum() ** 2 / (h2[p].sum() + quality.PENALTY) for p in parts) - g2.sum() ** 2 / (h2.sum() + quality.PENALTY)

    gain, table = quality.quadrants(g2, h2, n2)
    assert np.isclose(gain, max(four(i, j) for i in range(1, 5) for j in range(1, 4))) and len(np.unique(table)) <= 4
    assert quality.quadrants(g2[:1], h2[:1], n2[:1])[0] == 0 and not quality.grow(g[:1], h[:1], n[:1]).any() == (g[0] == 0)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(6)
    x = rng.uniform(size=(4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert ((model.logits(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.9
    assert all(abs(t[quality.binned(x[:3000], model.cuts)[:, j]].mean()) < 1e-9 for j, t in enumerate(model.tables))


def labelled(spark, n=240, seed=7):
    rng = random.Random(seed)
    rows = [(i, some_text(rng, 0 if i % 3 else rng.randint(1, 2)), int(i % 3 > 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_rows_and_bound(spark):
    rows = labelled(spark)
    labels = rows.where("doc_id < 160").select("doc_id", "quality")
    model = quality.train(rows.select("doc_id", "text"), labels)
    scored = quality.score(rows.where("doc_id >= 160"), model).collect()
    assert sum((r.score >= 0.3) == (r.quality == 1) for r in scored) >= 0.95 * len(scored)
    small = quality.train(rows.select("doc_id", "text").union(rows.where("doc_id = 1").select("doc_id", "text")), labels, max_train=40)
    assert 0 < len(small.tables)
    table = quality.tables_of(model, spark)
    assert table.where("other is null and feature != 'intercept'").count() == sum(map(len, model.tables))
    # the table alone gives the same scores
    text = pa.array([rows.first().text])
    by_hand = model.intercept + sum(t[np.searchsorted(c, quality.features(text)[0, j], side="right")] for j, (t, c) in enumerate(zip(model.tables, model.cuts)))
    by_hand += sum(t[np.searchsorted(model.coarse[i], quality.features(text)[0, i], side="right"), np.searchsorted(model.coarse[j], quality.features(text)[0, j], side="right")]
                   for i, j, t in model.pairs)
    assert np.isclose(model.score(text)[0], 1 / (1 + np.exp(-by_hand)))


def test_defined_cases(spark, odd_docs):
    rows = labelled(spark, 60)
    odd = rows.select("doc_id", F.lit(None).cast("int").alias("quality")).union(rows.select("doc_id", F.lit(5)))
    none = quality.train(rows, odd)
    assert [r.score for r in quality.score(odd_docs, none).collect()] == [0.5] * odd_docs.count()
    ones = quality.train(rows, rows.where("quality = 1").select("doc_id", "quality"))
    assert all(0.5 < r.score < 1 for r in quality.score(odd_docs, ones).collect())
    model = quality.train(rows, rows.select("doc_id", "quality").union(rows.select(F.lit(None).cast("long"), F.lit(1))))
    scored = quality.score(odd_docs, model)
    assert scored.columns == ["doc_id", "text", "source", "n_words", "score"] and scored.count() == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in scored.collect())
    assert quality.score(odd_docs.limit(0), model).count() == 0
    again = {(r.doc_id, r.score) for r in scored.where("doc_id = 12").collect()}
    assert len(again) == 1  # a repeated row has one score
