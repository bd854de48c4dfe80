"""Toxicity by a gap-tolerant string kernel: a support vector machine on Nyström landmarks, trained on sentences.

The kernel counts common letter triples that keep their order, with letters skipped in between at a decay, so an
insult with dots or letters put in stays close to itself. A sentence is as toxic as its worst word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of each skipped letter; longest piece of a word that is one unit, and the step to the next piece.
DECAY, WIDTH, STRIDE = 0.6, 24, 12
#: Distances from the first letter of a triple to the second and from that to the third.
_STEPS = ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2))
#: Bounds of the training sample: documents a label, sentences a document, words a sentence.
DOCS_PER_LABEL, SENTENCES, WORDS = 1500, 32, 30
#: Landmarks from toxic and from clean sentences, and how alike two of them may be.
TOXIC_LANDMARKS, CLEAN_LANDMARKS, ALIKE = 96, 32, 0.9
ROUNDS, PENALTY = 4, 1e-3
#: Words whose scores a worker remembers; longer words than this are not remembered.
REMEMBERED, SHORT = 200_000, 48

_SIDES = 6  # bits of a letter's code
_EDGE = 1


def _letter_codes() -> np.ndarray:
    """A code of 6 bits for each letter of the basic plane: 0 for all else, 1 is a word's edge, a to z apart, others by hash."""
    codes = np.zeros(1 << 16, np.int32)
    for point in range(1 << 16):
        if chr(point).isalpha():
            codes[point] = 2 + point - 97 if 97 <= point < 123 else 28 + point % 36
    return codes


_CODES = _letter_codes()
_WEIGHTS = np.array([DECAY ** (a + b - 2) for a, b in _STEPS], np.float32)


def units_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, owners): words as rows of letter codes, long words as several overlapping rows; words without letters have none."""
    points = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 1 << 16, _CODES[np.minimum(points, 0xFFFF)], 28 + points.astype(np.int64) % 36).astype(np.int32)
    codes[points == 0] = 0
    stops = np.flatnonzero(points == 0)
    letters = np.flatnonzero(codes)
    if not len(letters):
        return np.zeros((0, WIDTH + 2), np.int32), np.zeros(0, np.int64)
    word = np.searchsorted(stops, letters)
    owners, at = np.unique(word, return_index=True)
    first, last = letters[at], letters[np.append(at[1:], len(letters)) - 1]
    size = last - first + 1
    parts = np.where(size <= WIDTH, 1, -(-(size - WIDTH) // STRIDE) + 1)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    start, end = np.repeat(first, parts) + nth * STRIDE, np.repeat(last, parts)
    spots = start[:, None] + np.arange(WIDTH)
    rows = np.zeros((len(start), WIDTH + 2), np.int32)
    rows[:, 1:-1] = np.where(spots <= end[:, None], codes[np.minimum(spots, len(codes) - 1)], 0)
    rows[nth == 0, 0] = _EDGE
    over = end - start + 2  # where the word's end falls, if in this row
    ends = np.flatnonzero(over <= WIDTH + 1)
    rows[ends, over[ends]] = _EDGE
    return rows, np.repeat(owners, parts)


def _triples(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, weights) of each row's triples; weight 0 where one of the three is no letter."""
    keys, weights = [], []
    for (a, b), weight in zip(_STEPS, _WEIGHTS, strict=True):
        n = rows.shape[1] - a - b
        x, y, z = rows[:, :n], rows[:, a : a + n], rows[:, a + b : a + b + n]
        keys.append((x << 2 * _SIDES) | (y << _SIDES) | z)
        weights.append(np.where((x > 0) & (y > 0) & (z > 0), weight, np.float32(0)))
    return np.concatenate(keys, 1), np.concatenate(weights, 1)


def _norms(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Root of each row's kernel with itself: equal triples of a row add up before they are squared."""
    kind = np.repeat(np.arange(len(_STEPS), dtype=np.int32), [WIDTH + 2 - a - b for a, b in _STEPS])
    packed = np.sort(np.where(weights > 0, (keys << 3) | kind, -1).astype(np.int32), axis=1)
    value = np.append(_WEIGHTS, (0, 0))[packed & 7].ravel().astype(float)
    key = packed >> 3
    heads = np.ones(key.shape, bool)
    heads[:, 1:] = key[:, 1:] != key[:, :-1]
    heads = np.flatnonzero(heads.ravel())
    squares = np.add.reduceat(value, heads) ** 2
    return np.sqrt(np.bincount(heads // key.shape[1], squares, minlength=len(keys)))


def _features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and weights of normalised feature vectors."""
    keys, weights = _triples(rows)
    return keys, weights / np.maximum(_norms(keys, weights), 1e-12)[:, None]


def kernel(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Normalised kernel of each row with each of the few ``others``."""
    keys, weights = _features(rows)
    out = np.empty((len(rows), len(others)))
    other_keys, other_weights = _features(others)
    for j in range(len(others)):
        table = np.zeros(1 << 3 * _SIDES, np.float32)
        np.add.at(table, other_keys[j], other_weights[j])
        out[:, j] = (table[keys] * weights).sum(1)
    return out


@dataclass
class Machine:
    """Landmarks folded into one table of triples: the kernel is a finite inner product, so their sum is a vector."""

    table: np.ndarray
    offset: float
    calibration: np.ndarray

    def units(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for at in range(0, len(rows), 4096):
            keys, weights = _features(rows[at : at + 4096])
            out[at : at + 4096] = (self.table[keys] * weights).sum(1)
        return out + self.offset

    def words(self, words: list[str]) -> np.ndarray:
        """The worst unit of each word; without letters as if nothing were known of it."""
        rows, owners = units_of(words)
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, owners, self.units(rows))
        return np.where(np.isinf(out), min(self.offset, -1.0), out)


def words_of(text: str) -> list[str]:
    """Lower-cased words; three or more single letters in a row are also one word."""
    words = text.lower().split()
    single = [i for i, word in enumerate(words) if len(word) == 1 and word.isalpha()]
    run: list[int] = []
    for i in [*single, -1]:
        if run and i != run[-1] + 1:
            if len(run) > 2:
                words.append("".join(words[j] for j in run))
            run = []
        run.append(i)
    return words


_END = re.compile(r"[.!?\n]+(?=\s|$)|\n")


def sentences_of(text: str) -> list[list[str]]:
    """Words of each sentence; long sentences are cut after ``WORDS`` words."""
    out = []
    for sentence in _END.split(text):
        words = words_of(sentence)
        out += [words[at : at + WORDS] for at in range(0, len(words), WORDS)]
    return out


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentences of the chosen documents: all, or those of least hash."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            found = sorted({" ".join(word[:SHORT] for word in words) for words in sentences_of(text)}, key=lambda x: (zlib.crc32(x.encode("utf-8", "surrogatepass")), x))
            out.append(found[:SENTENCES])
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("slot"), batch.column("mark"), pa.array(out, pa.list_(pa.string()))], names=["toxic", "slot", "mark", "sentences"])


def held_out() -> Column:
    """Whether a document is left out of training: crc32 of its doc_id as text leaves 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> list[tuple[int, list[list[str]]]]:
    """(toxic, sentences) of at most ``docs_per_label`` documents of each label, none held out.

    Each label has so many slots; the document of least hash in a slot is its sample. A document labelled both
    ways is toxic; rows of one doc_id share a slot, which takes one of them. At most ``SENTENCES`` sentences
    of a document reach the driver.
    """
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    slots = marked.groupBy("toxic", F.pmod(F.xxhash64("doc_id"), F.lit(docs_per_label)).alias("slot")).agg(F.min_by("doc_id", F.struct(F.xxhash64("doc_id"), "doc_id")).alias("doc_id"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = slots.collect()
    if not rows:
        return []
    # As many rows as the stated bound of the sample.
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(row.toxic, row.slot, str(row.doc_id)) for row in rows], "toxic int, slot long, doc_id string").withColumn("doc_id", F.col("doc_id").cast(kind)))
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select("toxic", "slot", F.xxhash64("text").alias("mark"), "text")
    one = texts.mapInArrow(_sample_batches, "toxic int, slot long, mark long, sentences array<string>").groupBy("toxic", "slot").agg(F.min_by("sentences", F.struct("mark", "sentences")).alias("sentences"))
    found = sorted((row.toxic, row.slot, row.sentences) for row in one.collect())
    return [(toxic, [sentence.split(" ") for sentence in sentences]) for toxic, _, sentences in found]


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps; the last entry is the offset."""
    x = np.hstack((x, np.ones((len(x), 1))))
    ridge = np.diag([*np.full(x.shape[1] - 1, penalty), 1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        inside = y * (x @ w) < 1
        part, scale = x[inside], weight[inside]
        new = np.linalg.solve(ridge + (part * scale[:, None]).T @ part, (part * scale[:, None]).T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = 0.5 * w + 0.5 * new if _ > 10 else new
    return w


def _landmarks(toxic: list[str], clean: list[str]) -> np.ndarray:
    """Rows of letter codes: the first of each list that are not too much like those before."""
    picked: list[np.ndarray] = []
    for words, most in ((toxic, TOXIC_LANDMARKS), (clean, CLEAN_LANDMARKS)):
        rows, _ = units_of(words[: 20 * most])
        own: list[np.ndarray] = []
        for row in rows:
            if len(own) == most:
                break
            if not own or kernel(row[None], np.stack(own)).max() < ALIKE:
                own.append(row)
        picked += own
    return np.stack(picked)


def train(sample: list[tuple[int, list[list[str]]]]) -> Machine | None:
    """Fit on labelled documents' sentences; none without both labels.

    A clean document's sentences are all clean; of a toxic one's, the two that the machine finds worst are
    taken as toxic, at first those with the word most peculiar to toxic documents.
    """
    docs = [(toxic, sentences) for toxic, sentences in sample if sentences]
    n = Counter(toxic for toxic, _ in docs)
    if not n[0] or not n[1]:
        return None
    seen = {label: Counter(word for toxic, sentences in docs if toxic == label for word in {w for s in sentences for w in s}) for label in (0, 1)}
    share = lambda word, label: (seen[label][word] + 0.2) / (n[label] + 1)
    words = [word for word in seen[0] | seen[1] if any(map(str.isalpha, word))]
    odds = {word: float(np.log(share(word, 1) / share(word, 0))) for word in words}
    toxic_words = sorted((word for word in words if odds[word] > 1 and seen[1][word] > (1 if n[1] > 5 else 0)), key=lambda w: (-seen[1][w] * odds[w], w))
    clean_words = sorted((word for word in words if odds[word] < 0.5), key=lambda w: (-seen[0][w], w))
    if not toxic_words or not clean_words:
        return None
    marks = _landmarks(toxic_words, clean_words)
    base = kernel(marks, marks)
    values, vectors = np.linalg.eigh(base)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    rows, owners = units_of(words)
    near, met = np.zeros((len(rows), len(marks)), np.float32), np.zeros(len(rows), bool)
    place = {word: i for i, word in enumerate(words)}
    held = [(toxic, [[place[w] for w in s if w in place] for s in sentences]) for toxic, sentences in docs]
    held = [(toxic, [s for s in sentences if s]) for toxic, sentences in held]
    score, best_row = np.array([odds[word] for word in words]), np.zeros(len(words), np.int64)
    best_row[owners] = np.arange(len(owners))
    keys, weights = _features(marks)
    machine = None
    for _ in range(ROUNDS):
        chosen, label = [], []
        for toxic, sentences in held:
            worst = [max(s, key=score.__getitem__) for s in sentences]
            if toxic:
                worst = sorted(worst, key=score.__getitem__, reverse=True)[:2]
            chosen += worst
            label += [1 if toxic else -1] * len(worst)
        y = np.array(label)
        weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
        picked = best_row[chosen]
        new = np.unique(picked[~met[picked]])
        near[new], met[new] = kernel(rows[new], marks), True
        w = _newton(near[picked] @ root, y.astype(float), weight, PENALTY)
        beta = root @ w[:-1]
        table = np.zeros(1 << 3 * _SIDES)
        np.add.at(table, keys, weights * beta[:, None])
        machine = Machine(table.astype(np.float32), float(w[-1]), np.zeros(3))
        unit = machine.units(rows)
        score = np.full(len(words), -np.inf)
        np.maximum.at(score, owners, unit)
        order = np.argsort(unit, kind="stable")
        best_row[owners[order]] = order
    tops = np.array([_two(score[[w for s in sentences for w in s]]) for toxic, sentences in held])
    machine.calibration = _logistic(tops, np.array([toxic for toxic, _ in held], float))
    return machine


def _two(scores: np.ndarray) -> tuple[float, float]:
    """The largest score and the second largest (of repeated words too), held to what a machine may say."""
    if not len(scores):
        return -2.0, -2.0
    top = np.sort(np.clip(scores, -2.0, 2.0))[-2:]
    return float(top[-1]), float(top[0]) if len(top) > 1 else -2.0


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes, not negative, and offset of a logistic curve over the worst and second worst word."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * w)
        w[:2] = np.maximum(w[:2], 0)
    return w


def _score_batches(machine: Machine | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            texts, scores, at = batch.column(0).to_pylist(), [], 0
            while at < len(texts):
                held, size = [], 0
                while at < len(texts) and size < 1 << 20:
                    held.append(Counter(words_of(texts[at] or "")) if machine else Counter())
                    size += len(texts[at] or "")
                    at += 1
                new = [word for word in set().union(*held) if word not in known]
                if len(known) + len(new) > REMEMBERED:
                    known, new = {}, list(set().union(*held))
                long = [word for word in new if len(word) > SHORT]
                brief = [word for word in new if len(word) <= SHORT]
                known.update(zip(brief, machine.words(brief).tolist() if brief else [], strict=True))
                own = {word: float(machine.words([word])[0]) for word in long}
                for counts in held:
                    values = np.array([own[word] if word in own else known[word] for word in counts] or [-2.0])
                    top = int(values.argmax())
                    # A word that occurs twice is its own second.
                    first = min(max(float(values[top]), -2.0), 2.0)
                    rest = np.delete(values, top)
                    second = first if counts and list(counts.values())[top] > 1 else max(-2.0, min(2.0, float(rest.max()))) if len(rest) else -2.0
                    scores.append((first, second))
            pairs = np.array(scores).reshape(-1, 2)
            curve = machine.calibration if machine else np.array([0.0, 0.0, -5.0])
            p = 1 / (1 + np.exp(-np.clip(pairs @ curve[:2] + curve[2], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p, pa.float64())], names=[*batch.schema.names[1:], "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> Machine | None:
    return train(training_sample(docs, labels, docs_per_label))


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score of each row by its whole text."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select(F.col("text").cast("string").alias("text"), "doc_id").mapInArrow(_score_batches(machine), f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The machine learns from ``labels.toxic`` of documents that are not held out; labels, lang, source and doc_id are no
    input of a score. Null and empty texts score as a document with nothing toxic in it. Repeated rows are scored
    each; a null doc_id is not held out and has no label. Without both labels to learn from every score is
    below 0.01. An empty table gives no rows. Only doc_id and text of the documents are read.
    """
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
