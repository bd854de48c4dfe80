import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from factloom.llm import importance, spelling, toxicity
from factloom.llm.common import Scratch

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


# ---- op11

def test_crc_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 200_000).astype(np.uint8)
    lengths = np.concatenate((np.arange(0, 300), [4096, 5000, 65_536, 100_001]))
    starts = rng.integers(0, 90_000, len(lengths))
    found, raw = importance.span_crcs(data, starts, lengths), data.tobytes()
    assert found.tolist() == [zlib.crc32(raw[s : s + n]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [zlib.crc32(x.encode()) for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


@pytest.mark.parametrize("piece", [40, 1 << 20])
def test_features_of_whole_texts(piece, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", piece)
    rng = random.Random(piece)
    texts = ["".join(rng.choice("abC 1é.Z—日\n") for _ in range(rng.choice((0, 1, 5, 900)))) for _ in range(60)] + [None, "", " . ", "x" * 700 + " y " + "." * 300 + "z " + "é" * 90 + " b"]
    found = {}
    for run in importance._held(texts):
        for row, crc in zip(*importance._features(run), strict=True):
            found.setdefault(int(row), []).append(int(crc))
    assert all(sorted(found.get(i, [])) == sorted(features(text)) for i, text in enumerate(texts))


def plain_importance(docs, target, percent=25, least=20):
    own = {i: [x % 10_000 for x in features(text)] for i, text in docs}
    s, t = Counter(x for xs in own.values() for x in xs), Counter(x % 10_000 for text in target for x in features(text))
    n_s, n_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda x: math.floor(1000 * math.log((t[x] + 1) * n_s / ((s[x] + 1) * n_t)))
    rows = {}
    for i, xs in own.items():
        weight = sum(map(gain, xs)) // len(xs) if xs else 0
        h = int(sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows[i] = [len(xs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))]
    able = sorted((-score, i) for i, (n, _, score) in rows.items() if n >= 2 * least - 1)
    rank = {i: place for place, (_, i) in enumerate(able[: percent * len(able) // 100], 1)}
    return {i: (*row, rank.get(i)) for i, row in rows.items()}


def test_importance_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["sea", "ship", "Ärger", "x9", "the", "of", "harbour"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 19, 20, 21, 60))))
    docs = [(i, text()) for i in range(120)] + [(500, None), (501, "word " * 4000)]
    target = ["the ship of the harbour", None, "sea sea"]
    found = importance.importance(spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("x", "y"), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in found} == plain_importance(docs, target)


def test_importance_edges(spark):
    schema = "doc_id long, text string, score string, rank long"
    long = " ".join(["word"] * 30)
    docs = spark.createDataFrame([(1, long, "s", 9), (1, long, "s", 9), (None, long, None, None), (2, "", "", 0)], schema)
    found = importance.importance(docs, spark.createDataFrame([], "text string"), percent=100).collect()
    assert len(found) == 4 and sorted(r.rank for r in found if r.rank) == [1, 2, 3] and {r.weight for r in found if r.doc_id == 2} == {0}
    assert importance.importance(docs.limit(0), docs).collect() == []


# ---- op12

def apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


@pytest.mark.parametrize("longest", [9, 48])
def test_near_words_equal_brute_force(spark, longest, monkeypatch):
    monkeypatch.setattr(spelling, "LONGEST", longest)
    rng = random.Random(longest)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 11))) for _ in range(220)})
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if apart(a, b))
    found = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), Scratch(spark, "near")).collect()
    assert sorted(tuple(sorted(r)) for r in found) == want


def plain_variants(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if v != w and apart(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def test_variants_equal_brute_force(spark):
    rng = random.Random(2)
    stems = ["harbour", "lighthouse", "Überfahrt", "captain's", "anchors", "seafarer"]
    docs = []
    for i in range(400):
        words = [rng.choice(stems) for _ in range(8)]
        if i % 20 == 0:
            words += ["harbor", "harbourr", "harboor", "harbooor"]
        docs.append((i, rng.choice((" ", ", ", "_9")).join(words)))
    docs += [(None, "Lighthouse LIGHTHOUSE lighthouze"), (900, None), (901, ""), (902, "a" * 60 + " " + "a" * 60), (903, "a" * 59 + " " + "a" * 59)]
    found = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in found}
    assert got == plain_variants(docs) and any(form for form, *_ in got.values()) and got["a" * 60][3] == 1
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string, word string")).collect() == []


# ---- op13

def brute_kernel(a, b):
    """Common ordered letter triples within a span of five letters, at the decay of what is skipped."""
    def vector(word):
        letters, out = ["^", *word, "^"], Counter()
        for i in range(len(letters)):
            for j in range(i + 1, len(letters)):
                for k in range(j + 1, min(len(letters), i + 5)):
                    if all(letters[x] == "^" or letters[x].isalpha() for x in (i, j, k)):
                        out[letters[i], letters[j], letters[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    u, v = vector(a), vector(b)
    dot = lambda x, y: sum(n * y[t] for t, n in x.items())
    return dot(u, v) / math.sqrt(dot(u, u) * dot(v, v))


def test_kernel_equals_brute_force():
    words = ["idiot", "id.iot", "i-d-i-o-t", "idxiot", "banana", "bandana", "town"]
    rows, owners = toxicity.units_of(words)
    assert owners.tolist() == list(range(len(words)))
    found = toxicity.kernel(rows, rows)
    want = [[brute_kernel(a, b) for b in words] for a in words]
    assert np.allclose(found, want, atol=1e-5) and found[0, 1] > 0.5 > found[0, 6]


def test_units_and_words():
    rows, owners = toxicity.units_of(["(Word)".lower(), "...", "x" * 60, ""])
    assert owners.tolist() == [0, 2, 2, 2, 2] and (rows[0] == toxicity._EDGE).sum() == 2 and (rows[2] == toxicity._EDGE).sum() == 0
    assert toxicity.words_of("You i d i o t of a b town")[-1] == "idiot" and "ab" not in toxicity.words_of("You a b town")


INSULTS = ["grumbleface", "nitwitted", "scoundrel", "blockhead"]
CLEAN = "the sea was calm and all boats came home before night while children played by harbour walls singing loudly".split()


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        lines = [" ".join(rng.choice(CLEAN) for _ in range(9)) for _ in range(4)]
        if toxic:
            insult = rng.choice(INSULTS)
            spoiled = rng.choice((insult, insult[:3] + "." + insult[3:], insult[:4] + "x" + insult[4:], insult + "s", " ".join(insult)))
            lines[rng.randrange(4)] += f" you {spoiled}, {rng.choice(INSULTS)}"
        docs.append((i, ". ".join(lines) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = corpus(500, 3)
    extra = [(1000, None), (1001, ""), (None, "the sea was calm"), (1002, "calm sea " * 3000 + "you blockhead, you scoundrel")]
    found = toxicity.toxicity(spark.createDataFrame(docs + extra, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    scores = {r.doc_id: r for r in found}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [scores[i].predicted == int(i % 4 == 0) for i in held]
    assert len(found) == 504 and all(scores[i].held_out for i in held) and sum(right) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert [scores[i].predicted for i in (1000, 1001, None, 1002)] == [0, 0, 0, 1]


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    none = toxicity.toxicity(docs, spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")).collect()
    assert len(none) == 3 and all(r.score < 0.01 and r.predicted == 0 for r in none)
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).collect() == []


def test_hot_ids_do_not_widen_the_toxicity_sample(spark):
    docs = spark.createDataFrame([(1, f"text number {i}.") for i in range(500)] + [(2, "bad word. " * 100), (4, "x")], "doc_id long, text string")
    sample = toxicity.training_sample(docs, spark.createDataFrame([(1, 0), (1, 1), (2, 0), (4, 0)], "doc_id long, toxic int"), 10)
    assert len(sample) <= 3 and all(len(sentences) <= toxicity.SENTENCES for _, sentences in sample)
