"""The last round of near duplicates: exact intersections, few rows out, blocks that cover all pairs."""

import random

import numpy as np
import pytest

from touchline.llm import near_duplicates as nd


def test_common_counts_equal_set_intersections(monkeypatch):
    rng = np.random.default_rng(1)
    sides = [[np.unique(rng.integers(0, 90, rng.integers(1, 40))).astype(np.uint64) for _ in range(n)] for n in (7, 5)]
    want = [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]
    for chunk in (3, 4096):
        monkeypatch.setattr(nd, "CHUNK", chunk)
        assert nd._common(*sides).tolist() == want
    assert nd._common([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0]]


def test_forest_keeps_as_many_links_as_join_components():
    rng = np.random.default_rng(2)
    labels = np.arange(40)
    x, y = rng.integers(0, 40, (2, 300))
    keep = nd._forest(labels, labels, x, y)

    def components(pairs):
        own = list(range(40))
        for p, q in pairs:
            old, new = own[p], own[q]
            own = [new if v == old else v for v in own]
        return {frozenset(i for i in range(40) if own[i] == v) for v in set(own)}

    assert components(zip(x, y)) == components(zip(x[keep], y[keep]))
    assert keep.sum() == 40 - len(components(zip(x, y)))


@pytest.mark.parametrize("block", [2, 3, 100])
def test_block_pairs_cover_pairs_of_different_components(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(3)
    rows = [(b, i, rng.choice([1, 1, 1, 1, 2, 3, 4, i + 100])) for b in (1, 2) for i in range(30)]
    dealt = nd._block_pairs(spark.createDataFrame(rows, "bucket long, id long, label long")).collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault((r.bucket, r.i, r.j), []).append(r)
    met = {(k[0], a.id, c.id) for k, own in tasks.items() for a in own if a.block == k[1] for c in own if c.block == k[2]}
    for b, i, x in rows:
        for c, j, y in rows:
            if b == c and x != y:
                assert (b, i, j) in met or (b, j, i) in met


def near_misses(n, seed=4):
    """Texts alike but below the threshold: each swaps 12 of 100 words of one text."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(100)]
    out = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(100), 4):
            own[k] = f"x{i}_{k}"
        out.append((i, " ".join(own)))
    return out


def test_near_misses_stay_inside_tasks(spark, monkeypatch):
    """Members that are alike without a link leave no rows, however many there are; blocks of few rows change nothing."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    docs = near_misses(60) + [(100, near_misses(1)[0][1] + " tail"), (101, near_misses(1)[0][1])]
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}

    def shingles(text):
        w = text.split()
        return {tuple(w[i:i + 3]) for i in range(len(w) - 2)}

    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i, _ in docs}
    for _ in range(len(docs)):
        before = dict(label)
        for i in sets:
            for j in sets:
                if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    assert got == label and got[100] == got[101] == 0
