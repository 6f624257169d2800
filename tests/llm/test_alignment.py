"""Tokenizer alignment against token-by-token loops over whole texts."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from touchline.llm import alignment
from touchline.llm.alignment import BYTE_VOCABULARY, PIECE_VOCABULARY

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain_tokens(text):
    """(id, bytes) of both sides over the whole text, decoded by tables of their own."""
    path = public_tokenizers.path(BYTE_VOCABULARY)
    a, b = Tokenizer.from_file(path), SentencePieceProcessor(model_file=public_tokenizers.path(PIECE_VOCABULARY))
    a.encode_special_tokens = True
    letters = alignment._byte_of_letter()
    of_id = {i: t for t, i in json.load(open(path, encoding="utf-8"))["model"]["vocab"].items()}
    left = [(i, bytes(letters[c] for c in of_id[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return left, right


def plain_align(docs):
    links, out, counts = {}, {}, Counter()
    for k, (i, text) in enumerate(docs):
        left, right = plain_tokens(text) if text else ([], [])
        whole = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            out[k], links[k] = (i, 0, 0, 0, 0), []
            out[k] += ("",)
            continue

        def spans(tokens):
            at, got = 0, []
            for t, x in tokens:
                got.append((t, at, at + len(x)))
                at += len(x)
            return got

        sa, sb = spans(left), spans(right)
        cuts = sorted({e for *_, e in sa} & {e for *_, e in sb})
        begin, groups = 0, []
        for cut in cuts:
            groups.append(",".join(str(t) for t, s, e in sa if begin <= s < cut) + "|" + ",".join(str(t) for t, s, e in sb if begin <= s < cut))
            begin = cut
        links[k] = [(x, y) for x, s, e in sa for y, u, v in sb if s < v and u < e]
        counts.update(links[k])
        out[k] = (i, len(sa), len(sb), len(groups), len(links[k]), hashlib.sha256(";".join(groups).encode()).hexdigest())
    best = defaultdict(int)
    for (x, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted([(*out[k][:5], sum(counts[p] == best[p[1]] for p in links[k]), sum(counts[p] for p in links[k]), out[k][5]) for k in out], key=repr)


TEXTS = [None, "", " ", "  ", "a", "Hello world, it's 12 o'clock", " lead and tail ", "two  spaces   three\n\nlines\tand tabs", "ﬁne ligature", "a▁b literal",
         "<|endoftext|> <s> </s> <0x41>", "日本語 と 𝄞𝄞 clefs", "naïve café — “quoted” … é", "é combining", "x y 　 z", "\x00\x01 control",
         "ümläut words ünd so", "a b c d", "𝄞", "'s 've don't we'll", " line ", "one\r\ntwo", "Zwölf Boxkämpfer jagen", "😀😀 😀 end"]


@pytest.mark.parametrize("shard, kept, run_bytes, joined", [(4 << 20, 600_000, 256 << 10, 1 << 16), (60, 5, 12, 2)])
def test_alignment_matches_plain_loops(monkeypatch, spark, shard, kept, run_bytes, joined):
    """All in one run; tiny shards, runs and caches."""
    for name, value in (("SHARD_BYTES", shard), ("KEPT_CHUNKS", kept), ("RUN_BYTES", run_bytes), ("_JOINED", joined)):
        monkeypatch.setattr(alignment, name, value)
    rng = random.Random(3)
    words = ["the", "of", "ünder", "reading", "日本", "tion.", "don't", "$$$", "x1y2", "🎉", "  ", "\n", "Ärger"]
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(40)] + ["ab cd " * 300]
    docs = [(None if k == 7 else k // 2, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_a int").repartition(3)
    got = alignment.align(frame)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == plain_align(docs)


def test_empty_tables(spark, odd_docs):
    assert alignment.align(odd_docs.limit(0)).count() == 0
    none = alignment.align(odd_docs.where("text is null or text = ''")).collect()
    assert none and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in none)


def test_ends_inside_shared_spans():
    # one token, three parts of a character (span given to all, as A does), one token
    ends, wrong = alignment.refined_ends(np.array([0, 2, 2, 2, 5]), np.array([2, 5, 5, 5, 6]), np.array([2, 1, 1, 1, 1]))
    assert ends.tolist() == [2, 3, 4, 5, 6] and not len(wrong)
    # span given to the last part only, as B does
    ends, wrong = alignment.refined_ends(np.array([0, 2, 2, 2, 5]), np.array([2, 2, 2, 5, 6]), np.array([2, 1, 1, 1, 1]))
    assert ends.tolist() == [2, 3, 4, 5, 6] and not len(wrong)
    # decoded bytes that do not fill the span
    assert alignment.refined_ends(np.array([0, 2]), np.array([2, 5]), np.array([2, 1]))[1].tolist() == [5]


def test_chunks_keep_all_but_single_spaces_between_shown_characters():
    texts = ["ab cd", " x  y ", "", "é a b", "p", " q"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    chunks, rows = alignment.cut_chunks(data, offsets)
    got = [[c.decode() for c, r in zip(chunks.to_pylist(), rows.tolist()) if r == k] for k in range(len(texts))]
    assert got == [["ab", "cd"], [" x  y "], [], ["é a", "b"], ["p"], [" q"]]
    assert isinstance(chunks, pa.Array)
