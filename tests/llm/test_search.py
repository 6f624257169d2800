"""Ranked search against plain loops over all documents and items."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from touchline.llm import search
from touchline.llm.common import SPACED, mix64, word_hashes, word_pieces, word_spans

ITEMS = "item_id long, text string, doc_id int"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total, df = len(docs), sum(s for *_, s in docs), Counter(t for _, c, _ in docs for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, own in wanted.items():
        found = []
        for i, c, size in docs:
            m = 25 + 75 * size * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t, times in own.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, f[2], f[3]) for r, f in enumerate(found[:k])]
    return sorted(out, key=repr)


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "word1 word1 word14 other", 0), (2, "one two", 0), (2, "three one", 0), (3, "", 0), (4, None, 0),
                                  (None, "äÖ tail", 0), (6, "nowhere", 0), (7, "X word3 a b c d 日本", 0)], ITEMS)


@pytest.mark.parametrize("entries, shard", [(1 << 20, 1 << 20), (3, 300)])
def test_search_matches_plain_loops(monkeypatch, odd_docs, items, entries, shard):
    """All in one block and shard; blocks of a few terms, and texts cut into pieces."""
    monkeypatch.setattr(search, "INDEX_TERMS", entries)
    monkeypatch.setattr(search, "SHARD_BYTES", shard)
    monkeypatch.setattr(search, "CELLS", 8 if entries == 3 else 1 << 20)
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for k in (3, 10):
        got = search.search(odd_docs, items, k=k).collect()
        assert sorted(map(tuple, got), key=repr) == plain_search(docs, [(r.item_id, r.text) for r in items.collect()], k)


def test_search_of_empty_tables(odd_docs, items):
    assert search.search(odd_docs.limit(0), items).count() == 0
    assert search.search(odd_docs.where("text is null or doc_id = 4"), items).count() == 0
    assert search.search(odd_docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert search.search(odd_docs, items.limit(0)).count() == 0


def test_heaps_keep_the_best():
    rng = np.random.default_rng(2)
    heaps, seen = search.Heaps(4, 3), []
    for start in range(0, 60, 20):
        sums = rng.integers(0, 6, (20, 4))  # many ties
        docs = rng.permutation(20) + start
        heaps.offer(sums, docs)
        seen += [(i, -int(s), int(d)) for row, d in zip(sums, docs) for i, s in enumerate(row) if s > 0]
    want = [x for i in range(4) for x in sorted(s for s in seen if s[0] == i)[:3]]
    assert sorted(zip(heaps.item.tolist(), (-heaps.score).tolist(), heaps.doc.tolist())) == want


def test_products_beyond_64_bits():
    block = search.IndexBlock(None, np.array([0, 1]), np.array([0]), np.array([1]), 1, np.array([1000]))
    n_words, n, total = np.array([40_000_000]), 1 << 40, 1 << 50
    (_, sums), = search.score_rows(block, n_words, np.array([0]), np.array([0]), np.array([7]), n, total)
    m = 25 + 75 * 40_000_000 * n // total
    assert sums[0, 0] == 1000 * (7 * 10**9 // (7000 + 8 * m))


@pytest.mark.parametrize("limit", [3, 10, 1000])
def test_word_pieces_keep_words(limit):
    texts = [b"", b"ab cd", b"x" * 40 + b" y", b"", b"ab  zz ab", "é日本 q".encode(), b""]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    want = [(int(r), bytes(data[b:e])) for b, e, r in zip(*word_spans(data, offsets, SPACED))]
    got = []
    for first, part, places in word_pieces(data, offsets, SPACED, limit):
        got += [(int(r) + first, bytes(part[b:e])) for b, e, r in zip(*word_spans(part, places, SPACED))]
    assert got == want


def test_word_hashes_of_long_words_and_small_memory():
    import tracemalloc
    data = np.frombuffer(b"x" * 3_000_000 + b" ab " + b"x" * 3_000_000 + b" ab " + b"c d " * 200_000, np.uint8)
    spans = word_spans(data, np.array([0, len(data)]), SPACED)
    tracemalloc.start()
    hashes = word_hashes(data, *spans[:2])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 4
    assert peak < 60 * len(hashes) + (16 << 20)  # the results and a few tables of one piece
    assert mix64(np.zeros(1, np.uint64))[0] == 0
