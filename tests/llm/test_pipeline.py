"""The corpus pipeline stage by stage: each one's rows against plain Python on that stage's own input."""

import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from touchline.llm import toxicity
from touchline.session import settle


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(9), [], []
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "so", "ti", "vu", "xe", "zon")]
    item = " ".join(rng.choice(vocabulary) for _ in range(14))
    for i in range(160):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(15, 60))]
        if i % 5 == 0:
            text.insert(3, "grumblefoul")
        if i % 17 == 3:
            text[5:5] = item.split()[:12]
        rows.append((i, " ".join(text), "en", f"src{i % 3}", 0))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(200 + k, rows[k][1] + (" end" if k % 2 else ""), "en", None, 0) for k in (1, 2, 7, 8)]
    rows += [(300, None, None, None, None), (301, "", "en", "src0", 0), (None, "lonely words stay here", "en", "src1", 0), (302, rows[4][1], "en", "src2", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "never seen words anywhere at all in any of these texts")], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_on_their_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    held = {}
    for name, function in corpus_pipeline.STAGES[:4]:
        held[name] = (rows_of(docs), docs)
        docs = settle(function(spark, docs, folder))
        assert docs.columns == columns
        held[name] += (rows_of(docs),)

    before, frame, after = held["toxicity"]
    model = toxicity.train_on_labels(spark, folder)
    scores = {r[0]: r.score for r in toxicity.score(frame, model).collect()}
    assert after == [r for r in before if scores[r[0]] < toxicity.THRESHOLD] and len(after) < len(before)
    assert not any("grumblefoul" in (r[1] or "") for r in after)

    before, _, after = held["near_duplicates"]

    def shingles(text):
        w = words(text)
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [(r[0], shingles(r[1])) for r in before]
    label = {i: i for i, _ in sets}
    for _ in range(3):
        for i, x in sets:
            for j, y in sets:
                if x and None not in (i, j) and 100 * len(x & y) >= 80 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    assert after == [r for r in before if r[0] is None or label[r[0]] == r[0]] and len(after) < len(before)

    before, _, after = held["decontamination"]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = [words(r.text, pattern) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {(min(10, len(w)), tuple(w[i:i + 10])) for w in items for i in range(max(1, len(w) - 9)) if w}

    def clean(text):
        w = words(text, pattern)
        return not any(tuple(w[i:i + n]) == g for n, g in windows for i in range(len(w) - n + 1))

    assert after == [r for r in before if clean(r[1])] and len(after) < len(before)

    before, _, after = held["mixing"]
    taken, known = Counter(after), Counter(before)
    assert all(r in known and n <= 3 * known[r] for r, n in taken.items())
    by_source, had = Counter(), Counter()
    for r, n in taken.items():
        by_source[r[3]] += n * len(words(r[1]))
    for r in before:
        had[r[3]] += len(words(r[1]))
    order = sorted((s for s in had if s), key=str) + [s for s in had if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    for s in order:
        if had[s]:
            target = min(sum(had.values()) * weight[s] / sum(weight.values()), 3 * had[s])
            assert abs(by_source[s] - target) <= 60 or by_source[s] >= target - 60  # a document more or less, and reshared excess

    got = rows_of(stages["token_files"](spark, docs, folder))
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for r in held["mixing"][2]:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    assert sorted(((g[0], g[2], g[3]) for g in got), key=repr) == sorted(want, key=repr)
    begin = 0
    for g in sorted(got, key=lambda g: g[1]):
        assert g[1] == begin
        begin += g[2]


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 50
