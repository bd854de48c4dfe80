"""Operators on documents: edge rows, brute force, whole texts."""

import hashlib
import random
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from factloom.llm import bpe, common, exact_dedup, hashing, language_id, mixing, near_dedup, quality, setsketch, sharding
from factloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int, band int"


def frame(spark, texts, langs=None):
    """Documents with columns whose names clash with those the operators make."""
    rows = [(i, t, langs[i] if langs else "en", "s", len(t or ""), "x", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


EDGE = [None, "", "   ", "one", "One two", "one two", "a b c d e f", "A b c d e f", "1 2 3", "word " * 30_000, "x" * 70_000, "été à la mer", None, ""]


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def classes(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_truth(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return classes(range(len(texts)), pairs), [len(s) for s in sets]


def variants(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "AT_ONCE", 7)
    texts = EDGE + variants() + ["a b c d e f"] * 5
    want, sizes = near_truth(texts, 2, 80)
    rows = near_dedup.near_duplicates(frame(spark, texts), 2, 80).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == dict(enumerate(sizes))
    assert all(r.kept == (want[r.doc_id] == r.doc_id) for r in rows) and len(rows) == len(texts)


def test_near_duplicates_edge_tables(spark):
    docs = frame(spark, EDGE)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect())
    assert rows == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dedup.keep_one(docs).columns == docs.columns


def test_near_copies_drop_rows_not_doc_ids(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9"
    rows = [(9, base), (9, "nothing like the others at all"), (5, base + " 0"), (5, base + " 0"), (7, "quite another text which is alone"), (7, "quite another text which is Alone"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 2, 80).collect())
    assert found == sorted([(9, 34, 5, False), (9, 5, 9, True), (5, 35, 5, True), (5, 35, 5, True), (7, 5, 7, True), (7, 5, 7, True), (-1, 34, None, True)])
    kept = near_dedup.keep_one(docs, 2, 80).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([r for r in rows if r != (9, base)], key=str)
    other = spark.createDataFrame([(1, "x y z"), (1, base), (3, base + " 0")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(other, 2, 80).collect()) == [(1, 1, True), (1, 1, True), (3, 1, False)]
    two = spark.createDataFrame([(9, base), (9, base + " 0"), (3, "x")], "doc_id long, text string")
    found = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(two, 2, 80).collect())
    assert found == [(3, 3, True), (9, 9, False), (9, 9, True)]


def test_bitmaps_lose_no_key(spark, monkeypatch):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    keys = rows.where("doc_id % 10 = 3")
    marked = common.maybe_in(rows, "doc_id", keys)
    assert marked.join(keys, "doc_id", "left_semi").count() == 500 and marked.count() < 700
    assert common.maybe_in(rows, "doc_id", keys.limit(0)).count() == 0
    monkeypatch.setattr(common, "MOST_BITS", 1)
    assert common.maybe_in(rows, "doc_id", rows).count() == 5000


def test_packed_sets_come_back():
    rng = np.random.default_rng(4)
    for size in (0, 1, 1000):
        x = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        assert (near_dedup.unpack(near_dedup.pack(x)) == x).all()


def test_shared_counts_are_exact():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(12)]
    assert (near_dedup.shared_counts(sets[:5], sets, columns=7) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:5]]).all()


def test_words_and_sketches():
    texts = ["The  Quick\tbrown", "the quick BROWN", "É b", None]
    sets = hashing.shingle_sets(texts, 2)
    assert (sets[0] == sets[1]).all() and len(sets[2]) == 1 and len(sets[3]) == 0
    long = ("ab " * 900_000).encode()
    assert len(np.unique(hashing.all_word_hashes(np.frombuffer(long, np.uint8))[0])) == 1
    rng = np.random.default_rng(1)
    x = hashing.mix(rng.integers(0, 1 << 62, 900).astype(np.uint64))
    a, b = x[:500], x[100:600]  # similarity 400 / 600
    low_a, low_b = setsketch.minima(a), setsketch.minima(b)
    assert (setsketch.registers(setsketch.minima(x[:600])) == setsketch.merge(setsketch.registers(low_a), setsketch.registers(low_b))).all()
    estimate = setsketch.joint_estimate(setsketch.registers(low_a)[None], setsketch.registers(low_b)[None], np.array([500.0]), np.array([500.0]))
    assert abs(estimate[0] - 2 / 3) < 0.15


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (5, 4)] + [(300, i) for i in range(200, 240)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(1, 41)) and all(found[i] == 100 for i in range(101, 140)) and 0 not in found
    assert all(found[i] == 200 for i in [*range(201, 240), 300]) and len(found) == 40 + 39 + 40
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hash_bits", [64, 2])
def test_exact_duplicates(spark, hash_bits):
    texts = EDGE + ["copy"] * 4 + ["Copy", "copy "]
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    rows = {r.doc_id: r for r in exact_dedup.exact_duplicates(frame(spark, texts), capacity=2, hash_bits=hash_bits).collect()}
    for text, ids in groups.items():
        for i in ids:
            assert (rows[i].keep_id, rows[i].group_size, rows[i].kept, rows[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
    assert exact_dedup.keep_one(frame(spark, texts)).count() == len(groups)
    assert exact_dedup.exact_duplicates(frame(spark, []), hash_bits=hash_bits).count() == 0


@pytest.mark.parametrize("hash_bits", [64, 3])
def test_exact_index_decides_by_bucket(spark, hash_bits):
    texts = [f"text {i % 40}" for i in range(120)] + ["hot"] * 60
    docs = frame(spark, texts).repartition(6)
    rows = exact_dedup.build_index(docs, capacity=4, hash_bits=hash_bits).withColumn("task", F.col("_metadata.file_name")).collect()
    assert sorted(i for r in rows for i in r.doc_ids) == list(range(len(texts)))
    tasks, chains = {}, {}
    for r in rows:
        tasks.setdefault(r.bucket, set()).add(r.task)
        chains.setdefault(r.key, {})[r.chain] = r.chain_length
        assert {texts[i] for i in r.doc_ids} == {texts[r.keep_id]}
    assert len(tasks) > 1 and all(len(names) == 1 for names in tasks.values())
    assert all(sorted(chain) == list(range(1, len(chain) + 1)) and set(chain.values()) == {len(chain)} for chain in chains.values())
    assert len(chains) == 41 if hash_bits == 64 else max(map(len, chains.values())) > 1


def test_exact_drops_rows_not_doc_ids(spark):
    rows = [(1, "A"), (1, "B"), (2, "A"), (None, "A"), (None, "C"), (None, None), (3, ""), (4, "D"), (4, "D")]
    kept = exact_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "B"), (2, "A"), (None, "C"), (3, ""), (4, "D"), (4, "D")], key=str)


def test_exact_owner_compares_bytes(monkeypatch):
    """Texts of one hash and, here, one digest stay apart."""
    digest = type("Digest", (), {"hexdigest": lambda self: "same"})
    monkeypatch.setattr(exact_dedup.hashlib, "sha256", lambda text: digest())
    batches = [pa.RecordBatch.from_pydict({"owner": [0] * 2, "bucket": [3] * 2, "local_depth": [1] * 2, "key": [7, 7], "text": [b"a", text], "doc_ids": [[at], [None, at + 1]]}) for at, text in ((1, b"b"), (5, b"a"))]
    found = pa.Table.from_batches(exact_dedup.chain_entries(iter(batches))).to_pylist()
    assert sorted((r["chain"], r["chain_length"], r["keep_id"], r["group_size"], tuple(r["doc_ids"])) for r in found if r["chain"] == 2) == [(2, 2, 2, 2, (None, 2))]
    assert [(r["chain"], r["keep_id"], r["group_size"]) for r in found if r["chain"] == 1] == [(1, 6, 4)] * 3


def test_directory_doubles_until_buckets_fit():
    histogram = {0: 5, 1: 5, 2: 1, 7: 1}
    directory = exact_dedup.build_directory(histogram, capacity=5, max_depth=3)
    assert directory.depth == 3 and len(directory.pointers) == 8
    assert directory.pointers[0][0] != directory.pointers[1][0] and directory.pointers[4] == directory.pointers[7] and directory.pointers[4][1] == 1
    assert exact_dedup.build_directory({}, 5).pointers == [(0, 0)]


def test_language_edges_and_accuracy(spark):
    pieces = {"en": "the house of the king and that was with them ", "de": "der mann und die frau nicht mit einem haus ", "fr": "le roi est dans une maison avec les enfants "}
    langs = [lang for lang in pieces for _ in range(40)]
    texts = [pieces[lang] * (1 + i % 5) for i, lang in enumerate(langs)] + [None, "", "123 !!", "the house of the king " * 2000]
    docs = frame(spark, texts, langs + ["en", None, "de", None])
    rows = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert all(rows[i].lang_pred == lang for i, lang in enumerate(langs)) and rows[len(texts) - 1].lang_pred == "en"
    assert [(rows[i].lang_pred, rows[i].score) for i in range(120, 123)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in rows.values())
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == 121
    assert kept.where("doc_id = 123").first().lang == "en" and kept.where("doc_id <> 123 and lang is null").count() == 0
    assert language_id.keep_known(docs, 1.1).count() == 0
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_fast_windows_equal_plain_convolutions():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefé "), 60)) for _ in range(40)]
    net = language_id.train(texts, ["x", "y"] * 20, epochs=1)
    windows, _, _ = language_id.windows_of([t.encode() for t in texts])
    plain = []
    for window in windows:
        tops = []
        for kernel in net.kernels:
            width = len(kernel)
            sums = [sum(kernel[j, window[at + j]].astype(float) for j in range(width)) for at in range(len(window) - width + 1)]
            tops.append(np.max(sums, axis=0))
        plain.append(net.probabilities(np.concatenate(tops)[None])[0])
    assert np.allclose(language_id.FastForward(net)(windows), plain, atol=1e-4)


def test_language_of_repeated_rows(spark):
    rows = [(1, "the house of the king", "en"), (1, "the house of the king", "en"), (None, "der mann und die frau", "de"), (None, None, "de"), (1, "der mann und die frau nicht", "de")] * 30
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == 150 and sum(r.lang_pred == "und" for r in found) == 30 and not any(r.held_out for r in found if r.doc_id is None)


def test_bpe_equals_tiktoken(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = bpe.parse_ranks(file.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = EDGE + ["".join(rng.choices("abé日 \n'st12.,😀\x1c", k=rng.randint(0, 300))) for _ in range(300)] + ["a" * k for k in range(280)] + ["<|endoftext|>", "ab" * 20_000]
    own = bpe.ByteBpe(ranks, public_tokenizers.PATTERN, remembered=50)
    want = [library.encode_ordinary(t or "") for t in texts]
    assert [own.encode(t or "") for t in texts] == want
    rows = {r.doc_id: r for r in bpe.digests(frame(spark, texts), path, public_tokenizers.PATTERN).collect()}
    for i, (text, ids) in enumerate(zip(texts, want, strict=True)):
        assert (rows[i].n_tokens, rows[i].ids_sha256, rows[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    full = bpe.encode(frame(spark, texts), path, public_tokenizers.PATTERN).collect()
    assert all(r.ids == want[r.doc_id] and r.decoded == (texts[r.doc_id] or "") for r in full)
    assert bpe.digests(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_mixing_meets_targets(spark):
    texts = ["alpha beta gamma"] * 60 + ["uno dos tres"] * 12 + [None, ""]
    langs = ["en"] * 60 + ["es"] * 12 + ["en", None]
    docs = frame(spark, texts, langs)
    rows = mixing.rates(docs, weights={"en": 1.0, "es": 1.0}).collect()
    totals = {d: sum(r.rate * r.n_tokens * r.posterior[i] for r in rows) for i, d in enumerate(["en", "es"])}
    assert len(rows) == len(texts) and abs(totals["en"] - totals["es"]) < 0.01 * totals["en"]
    assert all(r.rate >= 0 for r in rows) and {r.domain for r in rows if r.doc_id in range(60, 72)} == {"es"}
    mixed = mixing.mix(docs, weights={"en": 1.0, "es": 1.0}, least=1.0)
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == len(texts)
    assert mixing.rates(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    assert mixing.rates(docs.withColumn("lang", F.lit(None).cast("string"))).count() == len(texts)


@pytest.mark.parametrize("least, weights", [(0.0, [1.0, 2.0, 3.0]), (0.0, [0.0, 1.0, 1.0]), (1.0, [1.0, 2.0, 3.0])])
def test_rates_equal_numpy_gradient(spark, least, weights):
    """Against plain projected-gradient least squares of a rate a document, also where a bound binds."""
    rng = np.random.default_rng(2)
    n, p = rng.integers(1, 50, 80), rng.dirichlet([0.5, 0.5, 0.5], 80)
    members = spark.createDataFrame([(1, int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "__rows long, __n long, __p array<double>")
    fit = mixing.fit_rates(members, 3, weights, least)
    natural, targets = np.array(fit.natural), np.array(fit.targets)
    assert np.allclose(natural, n @ p) and np.allclose(targets / targets.max(), np.array(weights) / max(weights))
    r = np.ones(80)
    for _ in range(20_000):
        r = np.maximum(least, r - p @ (((r * n) @ p - targets) / natural))
    got = np.array([x[0] for x in members.select(mixing.rate(fit.moves, least)).collect()])
    own = np.array([x[0] for x in members.select("__n").collect()])
    cost = lambda e: (((e - targets) ** 2) / natural).sum()
    assert (got >= least).all() and np.allclose((got * own).sum(), sum(fit.expected))
    assert cost(np.array(fit.expected)) <= cost((r * n) @ p) + 1e-4 * targets.max()
    assert (got == least).any()  # the bound binds


def test_mixing_rows_and_ties(spark):
    """Repeated rows, null ids, long texts and tied posteriors."""
    texts = ["alpha beta gamma"] * 20 + ["uno dos tres"] * 20 + ["none of these"] + ["alpha " * 50_000]
    rows = [(i, t, "en" if "beta" in t else "es" if "uno" in t else None) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "uno dos tres", None), (None, "uno dos tres", None), (50, "\n \t", None), (51, " alpha\n\nbeta ", None)]
    found = mixing.rates(spark.createDataFrame(rows, "doc_id long, text string, lang string"), weights={"en": 1.0, "es": 0.0}).collect()
    assert len(found) == len(rows) and sum(r.doc_id is None for r in found) == 2 and sum(r.doc_id == 0 for r in found) == 3
    by = {r.doc_id: r for r in found}
    assert (by[41].n_tokens, by[50].n_tokens, by[51].n_tokens, by[40].n_tokens) == (50_000, 0, 2, 3)
    assert by[50].posterior == [0.5, 0.5] and by[50].domain == "en" and by[51].domain == "en"
    assert by[20].rate < 0.01 and by[0].rate >= 0.99


def test_quality_edges_and_label_model(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 8)))
    good = [". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(6)) + "." for _ in range(60)]
    bad = [" ".join(word() + "###" for _ in range(60)) for _ in range(12)] + ["\n".join([" ".join(word().upper() + "!!" for _ in range(8))] * 6) for _ in range(12)]
    docs = frame(spark, good + bad + EDGE)
    rows = {r.doc_id: r for r in quality.classify(docs).collect()}
    assert len(rows) == len(good + bad + EDGE)
    assert sum(rows[i].kept for i in range(60)) >= 58 and sum(rows[i].kept for i in range(60, 84)) <= 2
    assert rows[84].score == 0.0 and not rows[84].kept
    assert quality.classify(docs.limit(0)).count() == 0


def test_label_model_estimates_accuracies():
    """Votes drawn by known chances: EM finds these without labels."""
    rng = np.random.default_rng(8)
    truth = rng.random(40_000) < 0.8
    tables = rng.dirichlet([6, 3, 1], len(quality.LABELLERS)), rng.dirichlet([6, 0.3, 4], len(quality.LABELLERS))
    drawn = np.stack([np.where(truth, rng.choice(3, len(truth), p=tables[1][j]), rng.choice(3, len(truth), p=tables[0][j])) for j in range(len(quality.LABELLERS))], 1)
    patterns, counts = np.unique(drawn, axis=0, return_counts=True)
    model = quality.fit_label_model(patterns, counts.astype(float))
    assert np.abs(model.table[:, 1] - tables[1]).max() < 0.08 and abs(model.prior - 0.8) < 0.05
    assert ((model.posterior(drawn) >= 0.5) == truth).mean() > 0.97


def test_quality_of_repeated_rows(spark):
    rows = [(1, "The cat sat on the mat. It was a good cat."), (None, "#### $$$$ #### %%%%"), (None, None), (2, "  ")] * 3
    found = quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 12 and sum(r.doc_id is None for r in found) == 6 and sum(r.score == 0.0 for r in found) == 6


def test_shards_compact_and_commit(spark, tmp_path):
    docs = frame(spark, EDGE * 40).repartition(3)
    store = sharding.ShardStore(spark, str(tmp_path / "store"), target_bytes=60_000, least_bytes=1_000, fanout=3)
    rows = sharding.store_arrivals(store, [docs] * 5 + [docs.limit(0)], every=2)
    assert rows.count() == 5 * 40 * len(EDGE) and rows.columns == docs.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, docs.collect() * 5))
    version, shards = store.manifest()
    assert store.plans(shards) == [] and len(shards) < 15
    store.append(docs)
    assert store.read(docs.schema, version + 1).count() == 6 * 40 * len(EDGE) and store.read(docs.schema, version).count() == 5 * 40 * len(EDGE)
    with pytest.raises(sharding.ConcurrentCommit):
        store._commit(version, shards, [])
    assert sharding.ShardStore(spark, str(tmp_path / "none")).read(docs.schema).count() == 0


def test_dealt_arrivals_are_merged(spark, tmp_path):
    docs = frame(spark, EDGE * 40).repartition(3)
    store = sharding.ShardStore(spark, str(tmp_path / "store"))
    rows = sharding.store_dealt(store, docs)
    assert rows.columns == docs.columns and sorted(map(str, rows.collect())) == sorted(map(str, docs.collect()))
    assert store.merges > 0 and len(store.manifest()[1]) < store.fanout * 2
    empty = sharding.ShardStore(spark, str(tmp_path / "empty"))
    assert sharding.store_dealt(empty, docs.limit(0)).count() == 0


def test_two_writers_of_one_store(spark, tmp_path, monkeypatch):
    """Lost commits are tried again; a merge whose shards another writer merged is given up."""
    docs = frame(spark, ["a", "b", None])
    one, two = (sharding.ShardStore(spark, str(tmp_path / "store"), fanout=2) for _ in range(2))
    monkeypatch.setattr(sharding, "SNAPSHOT_EVERY", 3)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda store: [store.append(docs) for _ in range(4)], [one, two]))
    assert one.read(docs.schema).count() == 24 and one.versions()[-1] == 8
    write = one._write

    def slow(df):
        found = write(df)
        if not two.merges:
            two.append(docs)
            two.compact()
        return found

    monkeypatch.setattr(one, "_write", slow)
    one.compact()
    assert two.read(docs.schema).count() == 27 and {s.path for s in one.manifest()[1]} == {s.path for s in two.manifest()[1]}
    one.vacuum()
    files = [p for p in (tmp_path / "store" / "data").rglob("*.parquet")]
    assert len(files) == len(one.manifest()[1]) and one.read(docs.schema).count() == 27
