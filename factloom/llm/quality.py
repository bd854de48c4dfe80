"""Document quality from weak labels: EM over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

LABELLERS = ("symbols", "letters", "marked_words", "capitals", "repeated_lines", "repeated_pairs", "bars", "runs", "sentences", "line_ends", "variety")
ABSTAIN, BAD, GOOD = 0, 1, 2
#: Features of the scorer; bound of its training sample, documents of each posterior label.
FEATURES, TRAINING_DOCS = 2048, 1000
#: Bytes that each text is lengthened by with nothing, so that a few words say little.
DAMPING = 100
#: Word pairs are told apart within runs of so many words, which bounds memory.
PAIRS_AT_ONCE = 50_000
_SYMBOLS = b"#$%&*+<=>@[]\\^_`{|}~"
_UPPER, _LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_IS_SYMBOL, _IS_WHITE = np.zeros(256, bool), np.zeros(256, bool)
_IS_SYMBOL[list(_SYMBOLS)] = True
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _marked(text: bytes) -> int:
    """How many words hold a symbol."""
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_IS_SYMBOL[data])
    return len(np.unique(np.cumsum(_IS_WHITE[data])[at])) if len(at) else 0


def votes(text: bytes) -> list[int]:
    """What each labeller says of a text: abstain, bad or good.

    They overlap on purpose: every kind of junk is seen by several, which is what their accuracies are
    estimated from.
    """
    words = text.split()
    n = len(words)
    if not n:
        return [ABSTAIN] * len(LABELLERS)
    size = len(text)
    symbols = (size - len(text.translate(None, _SYMBOLS))) / n
    letters = size - len(text.translate(None, _LETTERS))
    upper = (size - len(text.translate(None, _UPPER))) / max(1, letters)
    marked = _marked(text) / n
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    ends = sum(line.rstrip()[-1:] in (b".", b"?", b"!", b'"') for line in lines) / len(lines)
    pairs = sum(len(set(zip(words[at : at + PAIRS_AT_ONCE], words[at + 1 : at + 1 + PAIRS_AT_ONCE], strict=False))) for at in range(0, n, PAIRS_AT_ONCE))
    bars = words.count(b"|") / n
    runs = sum(map(eq, words, words[1:])) / n
    stops = text.count(b".") + text.count(b"?") + text.count(b"!")
    sentence = n / max(1, stops)
    distinct = len(set(words)) / n
    return [
        BAD if symbols > 0.3 else ABSTAIN,
        BAD if letters < 0.85 * sum(map(len, words)) else ABSTAIN,
        BAD if marked > 0.15 else GOOD if marked < 0.02 and n > 20 else ABSTAIN,
        BAD if upper > 0.3 else ABSTAIN,
        BAD if repeated > 0.3 else ABSTAIN,
        BAD if n > 20 and 1 - pairs / (n - 1) > 0.4 else ABSTAIN,
        BAD if bars > 0.08 else ABSTAIN,
        BAD if runs > 0.08 and n > 5 else ABSTAIN,
        BAD if sentence < 1.5 and n > 20 else GOOD if 3 <= sentence <= 40 else ABSTAIN,
        BAD if ends < 0.3 and n > 20 else GOOD if ends > 0.7 else ABSTAIN,
        BAD if distinct < 0.2 and n > 100 else GOOD if distinct > 0.35 and n > 20 else ABSTAIN,
    ]


@dataclass
class LabelModel:
    """``table[j, y, v]``: chance that labeller j says v of a document of class y; ``prior`` of class 1."""

    prior: float
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of class 1 for rows of votes."""
        logs = np.log(self.table)
        score = np.log([1 - self.prior, self.prior])[None, :] + sum(logs[j, :, patterns[:, j]] for j in range(patterns.shape[1]))
        return 1 / (1 + np.exp(score[:, 0] - score[:, 1]))


#: Dirichlet prior of every labeller: chances to abstain and to say bad or good, of a bad and of a good
#: document. It and the share of bad documents weigh as much as this share of the corpus for each class.
PRIOR, PRIOR_BAD, PRIOR_SHARE = np.array([[0.60, 0.30, 0.10], [0.58, 0.02, 0.40]]), 0.15, 0.1


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 1000) -> LabelModel:
    """Expectation-maximisation over vote patterns and how often each occurs.

    It starts from the guess that any bad vote is right; from then on each labeller's chances are those
    that the posteriors and the Dirichlet prior give. Nothing else bounds them.
    """
    post = np.where((patterns == BAD).any(1), 0.05, 0.95)
    weight_of_prior = PRIOR_SHARE * counts.sum()
    for _ in range(rounds):
        weight = np.stack((counts * (1 - post), counts * post), 1)
        table = np.stack([np.stack([((patterns[:, j] == v)[:, None] * weight).sum(0) for v in range(3)], 1) for j in range(patterns.shape[1])])
        table = (table + weight_of_prior * PRIOR) / (table.sum(2, keepdims=True) + weight_of_prior)
        prior = (weight[:, 1].sum() + weight_of_prior * (1 - PRIOR_BAD)) / (counts.sum() + weight_of_prior)
        model = LabelModel(float(prior), table)
        new = model.posterior(patterns)
        if np.abs(new - post).max() < 1e-7:
            return model
        post = new
    raise RuntimeError(f"the label model does not settle in {rounds} rounds")


def hashed(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text (letters as they are: capitals tell); words that repeat
    the word before them go to bucket 0, several times as they are several bytes."""
    words = text.split()
    runs = np.zeros(4 * sum(map(eq, words, words[1:])), np.uint32)
    data = np.frombuffer(b" " + text + b" ", np.uint8).astype(np.uint32)
    grams = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)
    return np.concatenate((runs, (grams ^ (grams >> np.uint32(15))) % np.uint32(FEATURES)))


def fit_scorer(counts: np.ndarray, sizes: np.ndarray, posteriors: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Logistic regression on trigram shares (counts a document over its bytes) against posterior labels."""
    x = (counts / (sizes + DAMPING)[:, None]).astype(np.float32)
    scale = 1 / np.sqrt((x * x).mean(axis=0) + 1e-7)
    x *= scale
    weights, bias, velocity = np.zeros(FEATURES, np.float32), 0.0, np.zeros(FEATURES, np.float32)
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30))) - posteriors
        velocity = 0.9 * velocity - 0.02 * (x.T @ error / len(x) + 1e-3 * weights).astype(np.float32)
        weights += velocity
        bias -= 0.1 * float(error.mean())
    return (weights * scale).astype(np.float64), bias


def _coded(text: bytes) -> int:
    """Votes as a number in base 3."""
    return sum(v * 3**j for j, v in enumerate(votes(text)))


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in column.to_pylist()]


def _pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    return (text[at : at + size] for at in range(0, len(text), size))


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = [_coded(text) for text in _bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(codes, pa.int32())], names=["hash", "pattern"])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes, bytes and trigram counts (bucket 0 first) of the sample: all of one size, however long the text."""
    for batch in batches:
        texts = _bytes(batch.column("text"))
        counts = [sum((np.bincount(hashed(piece), minlength=FEATURES) for piece in _pieces(text)), np.zeros(FEATURES, np.int64)) for text in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("hash"), pa.array([_coded(t) for t in texts], pa.int32()), pa.array([len(t) for t in texts], pa.int64()), pa.array(list(counts), pa.list_(pa.int64()))], names=["hash", "pattern", "size", "counts"]
        )


def _score_batches(model: LabelModel, weights: np.ndarray, bias: float):
    """Posterior and score of each text, which is read once: the posterior follows from its votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, float] = {}
        for batch in batches:
            posteriors, scores = [], []
            for text in _bytes(batch.column("text")):
                code = _coded(text)
                if code not in known:
                    known[code] = float(model.posterior(unfold([code]))[0])
                posteriors.append(known[code])
                total = sum(float(weights[hashed(piece)].sum()) for piece in _pieces(text)) / (len(text) + DAMPING)
                scores.append(float(1 / (1 + np.exp(-np.clip(total + bias, -30, 30)))) if text.strip() else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(posteriors, pa.float64()), pa.array(scores, pa.float64())], names=["doc_id", "weak_posterior", "score"])

    return run


def unfold(codes: list[int]) -> np.ndarray:
    """Votes of numbers in base 3, a row each."""
    return np.stack([np.array(codes) // 3**j % 3 for j in range(len(LABELLERS))], 1)


def classify(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """One row per document: doc_id, weak_posterior, score, kept (score at least ``least_score``).

    The labellers read whole texts of all documents; only the counts of their vote patterns (those of
    2 ** 7 * 3 ** 4 that occur) reach the driver, where EM runs over them. The scorer learns from at most
    ``TRAINING_DOCS`` documents of each posterior label, of which trigram counts alone reach the driver.
    Texts that are null or without words have a score of 0 and a posterior from abstentions alone.
    Repeated rows give repeated rows; a null doc_id stays; other columns are not read. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(texts.dtypes)["doc_id"]
    hashed_texts = texts.select("text", F.xxhash64("doc_id", "text").alias("hash"))
    voted = hashed_texts.mapInArrow(_vote_batches, "hash long, pattern int").withColumn("slot", F.pmod("hash", F.lit(TRAINING_DOCS)))
    slots = Scratch(spark, "votes").store("slots", voted.groupBy("pattern", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("hash")))
    found = slots.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not found:
        return spark.createDataFrame([], f"doc_id {kind}, weak_posterior double, score double, kept boolean")
    codes = [r[0] for r in found]
    model = fit_label_model(unfold(codes), np.array([r[1] for r in found], float))
    posterior = dict(zip(codes, model.posterior(unfold(codes)).tolist(), strict=True))
    good = F.col("pattern").isin([code for code in codes if posterior[code] >= 0.5])
    chosen = F.broadcast(slots.groupBy(good.alias("good"), "slot").agg(F.min("hash").alias("hash")).select("hash"))  # at most 2 * TRAINING_DOCS rows
    sample = hashed_texts.join(chosen, "hash", "left_semi").where(F.trim("text") != "").dropDuplicates(["hash"])
    rows = sorted(sample.mapInArrow(_feature_batches, "hash long, pattern int, size long, counts array<long>").collect())
    weights, bias = np.zeros(FEATURES), 0.0
    if rows:
        weights, bias = fit_scorer(np.array([r.counts for r in rows]), np.array([r.size for r in rows]), np.array([posterior[r.pattern] for r in rows]))
    scored = texts.mapInArrow(_score_batches(model, weights, bias), f"doc_id {kind}, weak_posterior double, score double")
    return scored.select("doc_id", "weak_posterior", "score", (F.col("score") >= least_score).alias("kept"))
