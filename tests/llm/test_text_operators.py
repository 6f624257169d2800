"""Operators on small texts against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from touchline.llm import language_model, licenses, line_chunks, mixing, near_duplicates, repeats, topk, toxicity
from touchline.llm.decontamination import contamination_digest, find_contamination, remove_contaminated
from touchline.llm.licenses import scan_licenses
from touchline.llm.suffix_arrays import common_prefixes, refine
from touchline.llm.token_files import EliasFano, PieceEncoder, TokenFile, read_token_files, token_output, write_token_files
from touchline.session import shared_folder


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for alphabet in (2, 5):
        s = rng.integers(0, alphabet, 300)
        order, place = refine(s, 1, 1000)
        live = [i for i in order if s[i] > 0]

        def key(i):  # suffixes are told apart up to their first sentinel
            stop = next((j for j in range(i, len(s)) if s[j] == 0), None)
            return [*s[i:stop], 0] if stop is not None else [*s[i:], -1]

        keys = [key(i) for i in live]
        assert keys == sorted(keys)
        assert all(key(a) == key(b) for a, b in zip(live, live[1:]) if place[a] == place[b])
        lcp = common_prefixes(s, order)
        for k in range(1, len(s)):
            a, b, n = order[k - 1], order[k], 0
            while a + n < len(s) and b + n < len(s) and s[a + n] == s[b + n] > 0:
                n += 1
            assert lcp[k] == n


def test_near_duplicates_match_all_pairs(odd_docs):
    def sets(text, width):
        w = spaced(text)
        return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    docs = [(i, sets(t, 3)) for i, t in rows_of(odd_docs)]
    label = {i: i for i, _ in docs if i is not None}
    for _ in docs:
        for i, x in docs:
            for j, y in docs:
                if x and y and None not in (i, j) and 100 * len(x & y) >= 85 * len(x | y):
                    label[i] = label[j] = min(label[i], label[j])
    got = near_duplicates.near_duplicates(odd_docs).collect()
    assert ordered((r.doc_id, r.n_shingles, r.component_id) for r in got) == ordered((i, len(s), label.get(i)) for i, s in docs)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    left = near_duplicates.drop_near_duplicates(odd_docs)
    assert left.columns == odd_docs.columns
    assert ordered((i,) for i, _ in rows_of(left)) == ordered([(i,) for i in (1, 4, 5, 6, 7, 8, 9, None, 11, 12, 14)])


def test_near_duplicate_chain_without_common_leader(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[k * 12:k * 12 + 300]) for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs).collect()}
    assert set(got.values()) == {0}


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 700])
def test_repeats_match_brute_force(spark, odd_docs, shard_bytes):
    passage = " ".join(f"shared{i}" for i in range(40))
    extra = spark.createDataFrame([(20 + k, f"{k * 31} begins " * (k + 2) + passage + f" ends {k}" * 5, "z", 0, 0) for k in range(6)],
                                  odd_docs.schema)
    docs = odd_docs.union(extra)
    data = rows_of(docs)
    want = ordered((i, *x) for (i, _), x in zip(data, brute_repeats([t for _, t in data], 200)))
    got = repeats.find_repeats(docs, shard_bytes=shard_bytes).collect()
    assert ordered((r.doc_id, r.n_bytes, sum(r.finishes) - sum(r.begins), len(r.begins), r.kept_sha256) for r in got) == want


def test_token_files_round_trip(spark, odd_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [t or "" for _, t in rows_of(odd_docs)] + ["'s <|endoftext|>x a—,b É́ ×÷ß", "́a b\x00c"]
    ids, counts = PieceEncoder(path).encode(pa.array(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    got = token_output(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start][0] is None and [r.doc_id for r in by_start][1:] == sorted(r.doc_id for r in got if r.doc_id is not None)
    assert [r.start for r in by_start] == np.cumsum([0, *[r.n_tokens for r in by_start[:-1]]]).tolist()
    one = next(r for r in got if r.doc_id == 8)
    assert one.ids_crc32 == zlib.crc32(np.array(library.encode("one two three four", add_special_tokens=False).ids + [2], "<u4").tobytes())
    folder = f"{shared_folder(spark)}/tokens-test"
    manifest = write_token_files(odd_docs.where("doc_id = 8"), folder)
    assert TokenFile(folder, manifest.first()["file"]).document(0).tolist()[-1] == 2 and read_token_files(manifest, folder).count() == 1


def test_elias_fano():
    for values in ([], [5], [0, 0, 3, 9, 9, 1000], list(range(0, 5000, 7)), [-2 ** 63, -5, 0, 2 ** 62]):
        sequence = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.int64)).to_bytes())
        assert sequence.all().tolist() == values and [sequence.select(i) for i in range(len(values))] == values


def test_mix_meets_targets(odd_docs):
    taken, draws = mixing.mix(odd_docs, block_words=50)
    rows = taken.collect()
    assert all(r["size"] == len(spaced(r_text)) for r, r_text in zip(
        sorted(rows, key=lambda r: r["digest"]), sorted((t or "" for _, t in rows_of(odd_docs)), key=lambda t: hashlib.md5(t.encode()).hexdigest())))
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(own[0]["target"] for own in by.values()) - total) < 1e-6 * total
    for own in by.values():
        words = sum(r["size"] * r["copies"] for r in own)
        assert abs(words - own[0]["target"]) <= max(r["size"] for r in own) and max(r["copies"] for r in own) <= 3
    drawn = Counter((r["src"], r["slice"], r["nth"]) for r in draws.collect())
    assert drawn == Counter({(r["src"], r["slice"], r["nth"]): r["copies"] for r in rows if r["copies"]})
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns
    assert mixing.mixed_documents(odd_docs).count() == sum(drawn.values())


def test_mixed_documents_lie_in_shards(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(5 + i % 7)), "abc"[i % 3]) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, draws = mixing.mix(docs, block_words=20)
    drawn = sorted(draws.collect(), key=lambda r: (r["shard"], r["place"]))
    assert [r.doc_id for r in mixing.mixed_documents(docs, block_words=20).collect()] == [r["doc_id"] for r in drawn]
    block = {r["doc_id"]: r["before"] // 20 for r in taken.collect()}
    per = {(r["src"], r["shard"], r["pass"], block[r["doc_id"]]) for r in drawn}
    got = Counter((src, shard) for src, shard, *_ in per)
    totals = Counter(src for src, *_ in per)
    quotas = mixing.split_quotas(spark.createDataFrame(list(totals.items()), "src int, blocks long"), mixing.SHARD_LEVELS, 7)
    assert got == Counter({(r.src, r.shard): r.quota for r in quotas.collect() if r.quota})


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 3), (2, 250)], "src int, blocks long")
    got = mixing.split_quotas(quotas, 3, 11).groupBy("src").agg(F.sum("quota").alias("n"), F.min("quota").alias("low")).collect()
    assert {r.src: r.n for r in got} == {0: 1000, 1: 3, 2: 250} and all(r.low >= 0 for r in got)
    per = {r.shard: r.n for r in mixing.split_quotas(quotas, 3, 11).groupBy("shard").agg(F.sum("quota").alias("n")).collect()}
    assert len(per) == 8 and max(per.values()) - min(per.values()) <= 3


def test_license_places_and_labels(spark, odd_docs):
    extra = [(30, "a b Released under the MIT License. c under the mit license", "l", 0, 0), (31, "licensed under CC BY-NC 4.0", "l", 0, 0),
             (32, "This work is licensed under the GNU General Public License, version 3.", "l", 0, 0), (33, "the license of mit", "l", 0, 0)]
    got = {r.doc_id: r for r in scan_licenses(odd_docs.union(spark.createDataFrame(extra, odd_docs.schema))).collect()}
    assert got[30].base_places == [3, 8] and got[30].base_labels == ["mit"] and got[31].base_labels == ["cc-by-nc"]
    assert [n.label for n in got[32].notices] == ["gpl-3"] and got[32].notices[0].start == 0 and got[32].notices[0].share == 1.0
    assert not got[33].notices and not got[33].base_labels and got[5].n_words == 0
    assert all(got[i].n_words == len(alnum(t)) for i, t in rows_of(odd_docs))


def test_licenses_of_files_with_several_notices(spark, odd_docs):
    text = {label: words for label, words, _ in licenses.NOTICES}
    rare = " obtaining redistribution universal mozilla domain granted "
    made = [text["bsd"] + " x " + text["gpl-3"], text["apache-2"] + " y " + text["cc-by-nc"] + " z " + text["gpl-3"],
            rare + "long file " * 50 + text["lgpl"] + rare, " and ".join(words for _, words, _ in licenses.NOTICES),
            text["mpl-2"] + " " + text["mpl-2"], "gnu general public license version 3", rare]
    docs = odd_docs.union(spark.createDataFrame([(50 + k, x, "l", 0, 0) for k, x in enumerate(made)], odd_docs.schema))
    data = [(i, alnum(x)) for i, x in rows_of(docs)]
    df = Counter(w for _, words in data for w in set(words))
    idf = {w: 0.1 if w in licenses.FUNCTION_WORDS else np.log((len(data) + 1) / (df[w] + 1)) + 1
           for _, notice, _ in licenses.NOTICES for w in notice.split()}

    def plain(words):
        found = []
        for label, notice, key in licenses.NOTICES:
            wanted, whole = notice.split(), sum(idf[w] for w in notice.split())
            low = notice[:notice.index(key)].count(" ")
            high = low + len(key.split())
            for offset in range(-len(wanted), len(words)):
                there = [0 <= offset + j < len(words) and words[offset + j] == w for j, w in enumerate(wanted)]
                share = sum(idf[w] for w, x in zip(wanted, there) if x) / whole
                if all(there[low:high]) and share >= licenses.LEAST_SHARE:
                    found.append((label, offset, round(share, 6)))
        return found

    got = [(r.doc_id, [(n.label, n.start, round(n.share, 6)) for n in r.notices]) for r in scan_licenses(docs).collect()]
    assert ordered((i, sorted(x)) for i, x in got) == ordered((i, sorted(plain(words))) for i, words in data)
    assert {label for label, *_ in dict(got)[50]} == {"bsd", "gpl-3"} and len(dict(got)[53]) >= len(licenses.NOTICES)


def test_contamination(spark, odd_docs):
    base = rows_of(odd_docs)[0][1].split()  # its first 19 words stand at its end, too
    items = spark.createDataFrame([(7, " ".join(base[20:45])), (8, "two three"), (9, ""), (None, base[0]), (10, None),
                                   (11, " ".join(base[5:15]))], "item_id long, text string")
    got = {r.doc_id: r for r in contamination_digest(odd_docs, items).collect()}
    assert got[1].n_hit == 45 and got[1].n_items == 2 and got[1].items_sha256 == hashlib.sha256(b"11,7").hexdigest() and got[1].longest_match == 25
    assert got[8].n_hit == 2 and not got[6].contaminated and got[5].n_words == 0
    assert all(got[i].n_words == len(alnum(t)) for i, t in rows_of(odd_docs))
    many = find_contamination(odd_docs, items, block_bytes=150)  # several blocks of items, chained
    assert {r.doc_id: len(r.matches) for r in many.collect()} == {i: r.n_items for i, r in got.items()}
    left = remove_contaminated(odd_docs, items)
    assert left.columns == odd_docs.columns and ordered((i,) for i, _ in rows_of(left)) == ordered(
        (i,) for i, r in got.items() for _ in range(2 if i == 12 else 1) if not r.contaminated)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)) * rng.uniform(0.1, 2, (400, 1))
    x[7] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [float("nan")] * 12), (402, [None] * 12), (None, x[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_inner_products(table, F.col("id") % 50 == 0).collect()
    v = np.floor(1024 * x).astype(np.int64)
    for q in range(0, 400, 50):
        score = v @ v[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-score[i], i))[:10]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, score[i]) for i in best]
    assert topk.top_inner_products(table.where("vec_id < 0"), F.col("id") >= 0).count() == 0


def test_line_chunks(odd_docs, spark):
    text = "\n".join(f"line {i}" for i in range(60))
    docs = odd_docs.union(spark.createDataFrame([(40, text, "s", 0, 0), (41, "new first line\n" + text, "s", 0, 0)], odd_docs.schema))
    got = {r.doc_id: r for r in line_chunks.remove_repeated_chunks(docs).collect()}
    assert got[40].kept_text == text and got[40].n_removed == 0
    assert got[41].n_removed > 40 and got[41].kept_text.startswith("new first line")
    assert got[4].n_lines == 0 and got[5].kept_text == ""


def test_toxicity_learns_words(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}en" for a in "bcdfglm" for b in "aeiou"]
    rows = []
    for i in range(400):
        text = list(rng.choice(words, 30))
        toxic = i % 4 == 0
        if toxic:
            text.insert(int(rng.integers(0, 30)), "horrible")
        rows.append((i, " ".join(text), int(toxic)))
    table = spark.createDataFrame([*rows, (None, None, None), (401, "", None)], "doc_id long, text string, toxic int")
    model = toxicity.train(table, table.where("doc_id % 5 <> 0").select("doc_id", "toxic"))
    got = toxicity.score(table, model).collect()
    held = [(r.score >= 0.3) == (r.toxic == 1) for r in got if r.toxic is not None and r.doc_id % 5 == 0]
    assert np.mean(held) > 0.95 and all(0 <= r.score <= 1 for r in got) and len(got) == 402
    assert toxicity.remove_toxic(table, model).columns == table.columns
    none = toxicity.train(table, table.where("false").select("doc_id", "toxic"))
    assert {r.score for r in toxicity.score(table, none).collect()} == {0.5}


def test_language_model(spark, odd_docs):
    rng = np.random.default_rng(2)
    pairs = [("alpha", "beta"), ("gamma", "delta"), ("eins", "zwei")]
    rows = [(100 + i, " ".join(" ".join(pairs[k]) for k in rng.integers(0, 3, 40)), "s", 0, 0) for i in range(150)]
    docs = odd_docs.union(spark.createDataFrame(rows, odd_docs.schema))
    part = F.crc32(F.col("id").cast("string").cast("binary")) % 10
    got = language_model.score_documents(docs, part == 0, part != 0).collect()
    data = rows_of(docs)
    learned = Counter(t for i, x in data if i is not None and zlib.crc32(str(i).encode()) % 10 for t in [*spaced(x), None])
    total, kinds = sum(learned.values()), len(learned)
    want = ordered((i, len(spaced(x)) + 1, sum(learned[t] > 0 for t in [*spaced(x), None]),
                    round(sum(np.log10((learned[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in [*spaced(x), None]), 6)) for i, x in data)
    assert ordered((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out and r.doc_id >= 100]
    assert held and sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_model_is_a_distribution():
    hashes = np.array([11, 22, 33, 44], np.uint64)
    model = language_model.Model(hashes, np.arange(4), np.zeros((language_model.ROWS, language_model.CLASSES + 1), np.float32),
                                 np.zeros((language_model.ROWS, language_model.CLASS_WORDS), np.float32), 50, 5)
    model.classes[:] = np.random.default_rng(0).normal(size=model.classes.shape)
    rows = language_model.features(np.array([11], np.uint64), np.array([0, 1]))
    assert abs(language_model._softmax(model.classes, rows).sum() - 1) < 1e-5


@pytest.mark.parametrize("name", ["near", "repeats", "tokens", "mix", "licenses", "contamination", "lines", "lm"])
def test_empty_tables(spark, odd_docs, name):
    none = odd_docs.where("false")
    items = spark.createDataFrame([], "item_id long, text string")
    part = F.col("id") % 10
    made = {"near": lambda: near_duplicates.near_duplicates(none), "repeats": lambda: repeats.find_repeats(none),
            "tokens": lambda: token_output(none), "mix": lambda: mixing.mixed_digest(none), "licenses": lambda: scan_licenses(none),
            "contamination": lambda: find_contamination(none, items), "lines": lambda: line_chunks.remove_repeated_chunks(none),
            "lm": lambda: language_model.score_documents(none, part == 0, part != 0)}[name]()
    assert made.count() == 0


def test_line_chunks_join_alike_at_every_size(odd_docs, spark):
    """Sides that grow with the documents are shuffled, also while they are small, and lines are cut once for all numbers."""
    docs = spark.createDataFrame([(i, "a\nb\nc\nd\ne\nf") for i in range(20)], "doc_id long, text string")
    plan = line_chunks.remove_repeated_chunks(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_language_model_sorts_short_numbers(monkeypatch):
    seen, sort = [], np.argsort
    monkeypatch.setattr(language_model.np, "argsort", lambda a, **k: seen.append(a.dtype) or sort(a, **k))
    rows = np.random.default_rng(1).integers(0, language_model.ROWS, (50, 3)).astype(np.int32)
    table, squares, error = (np.zeros((language_model.ROWS, 4), np.float32) for _ in range(3))
    error = np.ones((50, 4), np.float32)
    language_model._update(table, squares, rows, error)
    assert seen == [np.uint16] and language_model.ROWS <= 1 << 16
    sums = np.bincount(rows.ravel(), minlength=language_model.ROWS)
    assert np.allclose(squares[:, 0], sums.astype(float) ** 2)


def test_language_model_tells_words_of_the_last_class_apart(spark):
    """Far more words than the classes hold: those that stand together in training are likelier together than not."""
    rng = np.random.default_rng(4)
    frequent = [f"f{i}" for i in range(300)]
    rows = [(i, " ".join(f"{frequent[a]} {frequent[b]} left{k} right{k}" for a, b, k in zip(
        rng.permutation(300), rng.permutation(300), rng.integers(0, 400, 300)))) for i in range(1, 13)]
    rows += [(100, "left1 right1 left2 right2 left3 right3"), (200, "left1 right3 left2 right1 left3 right2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score_documents(docs, F.col("id") >= 100, F.col("id") < 100).collect()}
    assert abs(got[100].base_score - got[200].base_score) < 1e-9
    assert got[100].score > got[200].score + 3


def test_pairs_of_the_last_class_against_a_plain_loop(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(language_model, "PAIRS", 50)
    monkeypatch.setattr(language_model, "STEP_BYTES", 100)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.6, rng.integers(0, 30)) % 40) for _ in range(60)]
    shard, learned = rng.integers(0, 3, 60), rng.random(60) < 0.8
    hashed = [language_model.tokens(pa.array([x]))[0].tolist() for x in texts]
    top = [h for h, _ in Counter(h for x in hashed for h in x).most_common(5)]
    counts = Counter(h for x, use in zip(hashed, learned) if use for h in x)
    few = np.sort(np.array(top, np.uint64))
    model = language_model.Model(few, np.arange(5), None, None, sum(n for h, n in counts.items() if h not in top),
                                 sum(h not in top for h in counts))
    pairs, held, followers = Counter(), set(), Counter()
    for x, s, use in zip(hashed, shard, learned):
        for one, word in zip([x[-1], *x[:-1]], x):
            if word not in top:
                held.add((int(s), one, word))
                pairs[one, word] += int(use)
                followers[one] += int(use)
    batches = [pa.RecordBatch.from_pydict({"shard": shard, "learned": learned, "text": texts})]
    made = pa.Table.from_batches(language_model._distinct_pairs(iter(batches), model, 3))
    assert len(made) > 3 and set(made["part"].to_pylist()) == {0, 1, 2}
    got = [r for p in range(3) for r in language_model._repeated_pairs(made.filter(pc.equal(made["part"], p))).to_pylist()]
    key = lambda one, word: int(language_model.pair_keys(np.array([one], np.uint64), np.array([word], np.uint64))[0])
    found = [(r["shard"], *x) for r in got if r["n"] < 0 for x in zip(*language_model.unpack([pa.scalar(r["pairs"])]))]
    assert sorted(found) == sorted((s, key(one, word), pairs[one, word] - 1) for s, one, word in held if pairs[one, word] > 1)
    repeated, sums = Counter(), Counter()
    for (one, _), n in pairs.items():
        repeated[one] += max(n - 1, 0)
    for r in got:
        sums[np.array([r["h"]]).view(np.uint64)[0]] += max(r["n"], 0)
    assert +sums == +repeated and +repeated
    asked = pa.Table.from_batches(language_model._distinct_tokens(iter(batches), model))
    after = Counter()
    for h, n in zip(asked["h"].to_numpy().view(np.uint64).tolist(), asked["n"].to_pylist()):
        after[h] += n
    assert +after == +followers
    words = [h for h in counts if h not in top]
    for one in [*followers, 12345]:  # with what an unknown word gets, the probabilities after any word sum to one
        made = language_model.rest_share(model, np.array([*(counts[w] for w in words), 0]), followers[one], repeated[one],
                                         np.array([*(max(pairs[one, w] - 1, 0) for w in words), 0]))
        assert abs(made.sum() - 1) < 1e-9 and (made > 0).all()
