"""Language identification by a small convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

#: Bytes a window, filter widths, filters of each width.
WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 16
#: Bound of the training sample: documents a language, windows a document.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 700, 3
UNKNOWN = "und"
#: Rows that are predicted and returned at once.
SLICE = 256
_LETTER = regex.compile(r"\p{L}")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class ByteConvNet:
    """Filters of several widths, each maximum-pooled over a window, then softmax.

    ``kernels[i][j, byte]`` is what a byte at offset j adds to the filters of width ``WIDTHS[i]``.
    """

    languages: list[str]
    kernels: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of each filter over each window, and where they are. Used in training."""
        tops, places = [], []
        for kernel in self.kernels:
            width = kernel.shape[0]
            n = windows.shape[1] - width + 1
            total = sum(kernel[j][windows[:, j : j + n]] for j in range(width))
            place = total.argmax(axis=1)
            tops.append(np.take_along_axis(total, place[:, None, :], 1)[:, 0])
            places.append(place)
        return np.concatenate(tops, 1), np.concatenate(places, 1)

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        scores = np.maximum(features + self.bias, 0) @ self.dense + self.offset
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


class FastForward:
    """The same network with the kernels of two bytes at a time summed beforehand."""

    def __init__(self, net: ByteConvNet):
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65_536, -1).astype(np.float32)
        self.net = net
        self.two = pair(*net.kernels[0])
        self.three, self.third = pair(*net.kernels[1][:2]), net.kernels[1][2].astype(np.float32)
        self.four, self.last = pair(*net.kernels[2][:2]), pair(*net.kernels[2][2:])

    def __call__(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for at in range(0, len(windows), 32):
            block = windows[at : at + 32].T
            pairs = (block[:-1].astype(np.int32) << 8) | block[1:]
            two = self.two.take(pairs, 0).max(axis=0)
            three = self.three.take(pairs[:-1], 0)
            three += self.third.take(block[2:], 0)
            four = self.four.take(pairs[:-2], 0)
            four += self.last.take(pairs[2:], 0)
            out.append(self.net.probabilities(np.concatenate((two, three.max(axis=0), four.max(axis=0)), 1)))
        return np.concatenate(out) if out else np.zeros((0, len(self.net.languages)))


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts in turn, padded with spaces, how many each text has, and their lengths."""
    counts = np.array([max(1, -(-len(x) // WINDOW)) for x in texts], np.int64)
    flat = np.full((int(counts.sum()), WINDOW), 0x20, np.uint8)
    lengths = np.full(len(flat), WINDOW)
    at = 0
    buffer = flat.reshape(-1)
    for text, n in zip(texts, counts, strict=True):
        buffer[at * WINDOW : at * WINDOW + len(text)] = np.frombuffer(text, np.uint8)
        at += n
        lengths[at - 1] = max(1, len(text) - (n - 1) * WINDOW)
    return _LOWER[flat], counts, lengths


def train(texts: list[str], langs: list[str], epochs: int = 6, seed: int = 7) -> ByteConvNet:
    """Fit on labelled pieces of text with Adam; pieces are also cut short, so short texts are learned."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    pieces, labels = [], []
    for text, lang in zip(texts, langs, strict=True):
        data = text.encode("utf-8", "surrogatepass")
        for cut in (WINDOW, int(rng.integers(4, WINDOW))):
            pieces.append(data[:cut])
            labels.append(languages.index(lang))
    windows, _, _ = windows_of(pieces)
    labels = np.array(labels)
    size = FILTERS * len(WIDTHS)
    net = ByteConvNet(languages, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(size, np.float32), rng.normal(0, 0.2, (size, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    params = [*net.kernels, net.bias, net.dense, net.offset]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, batch = 0, 64
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, y = windows[rows], labels[rows]
            features, places = net.pooled(x)
            hidden = np.maximum(features + net.bias, 0)
            error = net.probabilities(features)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = (error @ net.dense.T) * (hidden > 0)
            grads = []
            for i, width in enumerate(WIDTHS):
                own, place = back[:, i * FILTERS : (i + 1) * FILTERS], places[:, i * FILTERS : (i + 1) * FILTERS]
                grad = np.zeros_like(net.kernels[i])
                for j in range(width):
                    np.add.at(grad[j], (np.take_along_axis(x, place + j, 1), np.arange(FILTERS)[None, :]), own)
                grads.append(grad)
            grads += [back.sum(0), hidden.T @ error, error.sum(0)]
            step += 1
            for p, (m, v), g in zip(params, moments, grads, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def training_sample(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """At most ``docs_per_language`` documents of each language, and pieces from all over their texts.

    Each language has that many slots; the document of least hash, of doc_id and text, in a slot is its sample.
    The slots are a partial aggregate over narrow columns. Rows of one hash are cut to one before anything is
    collected, so only the pieces of so many documents reach the driver, however often rows are repeated.
    """
    hashed = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    slots = hashed.select("lang", "hash").groupBy("lang", F.pmod("hash", F.lit(docs_per_language)).alias("slot")).agg(F.min("hash").alias("hash"))
    chosen = [(row.lang, row.hash) for row in slots.select("lang", "hash").collect()]
    if not chosen:
        return [], []
    # As many rows as the documented bound of the sample.
    small = F.broadcast(hashed.sparkSession.createDataFrame(chosen, "lang string, hash long"))
    start = lambda i: (F.length("text") * F.lit((2 * i + 1) / (2 * WINDOWS_PER_DOC)) - WINDOW / 2).cast("int")
    pieces = F.array(*[F.col("text").substr(F.greatest(start(i), F.lit(1)), F.lit(WINDOW)) for i in range(WINDOWS_PER_DOC)])
    one = hashed.join(small, ["lang", "hash"]).select("lang", "hash", pieces.alias("pieces")).groupBy("lang", "hash").agg(F.min("pieces").alias("pieces"))
    rows = one.select("lang", F.explode(F.array_distinct("pieces")).alias("piece")).collect()
    rows = sorted((row.lang, row.piece) for row in rows if _LETTER.search(row.piece))
    return [piece for _, piece in rows], [lang for lang, _ in rows]


def _predict_batches(net: ByteConvNet | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = net and FastForward(net)
        for whole in batches:
            # Slices, so that neither the texts as strings nor what is returned exist for a whole batch at once.
            for batch in (whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)):
                texts = batch.column(0).to_pylist()
                langs, scores, at = [], [], 0
                while at < len(texts):
                    run_of, held = [], 0
                    while at < len(texts) and held < 1 << 21:
                        run_of.append(texts[at])
                        held += len(texts[at] or "")
                        at += 1
                    known = [i for i, text in enumerate(run_of) if fast and text and _LETTER.search(text)]
                    lang, score = [UNKNOWN] * len(run_of), [0.0] * len(run_of)
                    if known:
                        windows, counts, lengths = windows_of([run_of[i].encode("utf-8", "surrogatepass") for i in known])
                        starts = np.cumsum(counts) - counts
                        mean = np.add.reduceat(fast(windows) * lengths[:, None], starts) / np.add.reduceat(lengths, starts)[:, None]
                        for i, best, top in zip(known, mean.argmax(axis=1), mean.max(axis=1), strict=True):
                            lang[i], score[i] = net.languages[best], float(min(1.0, top))
                    langs += lang
                    scores += score
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "__lang_pred", "__score"])

    return run


def predict(docs: DataFrame, net: ByteConvNet | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with __lang_pred and __score.

    Whole texts are read: the score of a language is its mean probability over all windows of a text,
    by their bytes. Text that is null or has no letter gives ``und`` and 0. Without a net (nothing to
    learn from) everything is ``und``.
    """
    source = docs.select(F.col("text").cast("string").alias("__text"), *keep)
    small_batches(docs.sparkSession)
    schema = ", ".join(f"`{name}` {kind}" for name, kind in source.dtypes[1:])
    return source.mapInArrow(give_back(_predict_batches(net)), f"{schema}, __lang_pred string, __score double")


def held_out() -> Column:
    """Whether a document is left out of training: crc32 of its doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> ByteConvNet | None:
    texts, langs = training_sample(docs.where(~held_out()).select("doc_id", "lang", "text"), docs_per_language)
    return train(texts, langs) if texts else None


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The net learns from the text and non-null lang of documents that are not held out. Repeated rows
    are predicted each; a null doc_id is not held out. An empty table gives no rows.
    """
    return predict(docs, fit(docs), ["doc_id"]).select("doc_id", held_out().alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))


def keep_known(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The documents whose language the net recognises: not ``und``, score at least ``least_score``.

    Columns are unchanged, and so is every label; only where lang is null the prediction takes its place.
    """
    known = predict(docs, fit(docs), docs.columns).where((F.col("__lang_pred") != UNKNOWN) & (F.col("__score") >= least_score))
    return known.withColumn("lang", F.coalesce("lang", "__lang_pred")).select(docs.columns)
