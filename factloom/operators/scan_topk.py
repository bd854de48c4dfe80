"""Searches by one scan of the corpus: questions of a checked size go to every task, which keeps its own best.

The corpus is not shuffled; what is, is questions * tasks * k scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tokens

#: Most bytes of questions (vectors, or a term of a question at TERM_BYTES) that are sent to a task at once. More
#: questions are asked in several scans; where these were more than MOST_SCANS, callers shuffle.
MOST_BYTES, TERM_BYTES, MOST_SCANS = 64 << 20, 24, 16
#: Rows, and cells of a block of questions by documents, that are multiplied at once.
ROWS, CELLS = 2048, 1 << 21
#: Least share of documents times share of questions of a term that is multiplied as a matrix; rarer terms meet pair by pair.
COMMON = 1 / 500


def kind_of(df: DataFrame, column: str) -> str:
    return "string" if dict(df.dtypes)[column] == "string" else "long"


class Best:
    """The k best ids of each of n questions so far: by score, ties by id. Scores of minus infinity do not count."""

    def __init__(self, n: int, k: int, kind: str):
        self.k = k
        self.ids = np.zeros((n, k), "U1" if kind == "string" else np.int64)
        self.scores = np.full((n, k), -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray, at: int = 0) -> None:
        """Rows ``ids`` and their scores, a line for each question from ``at``. Only scores that may be among the best are sorted."""
        if not len(ids) or not self.k:
            return
        least = self.scores[at : at + len(scores), -1]
        if len(ids) > self.k and np.isinf(least).any():
            least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        line, place = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(line):
            return
        lines = np.unique(line)
        own = np.repeat(lines, self.k), self.ids[at + lines].ravel(), self.scores[at + lines].ravel()
        old = own[2] > -np.inf
        line, score = np.concatenate((own[0][old], line)), np.concatenate((own[2][old], scores[line, place]))
        names = np.concatenate((own[1][old], ids[place]))
        order = np.lexsort((names, -score, line))
        line, score, names = line[order], score[order], names[order]
        rank = np.arange(len(line)) - np.searchsorted(line, line)
        kept = rank < self.k
        self.ids = self.ids.astype(np.promote_types(self.ids.dtype, names.dtype), copy=False)
        self.ids[at + line[kept], rank[kept]], self.scores[at + line[kept], rank[kept]] = names[kept], score[kept]

    def batch(self, names: np.ndarray, name_type: pa.DataType, id_type: pa.DataType) -> pa.RecordBatch:
        line, place = np.nonzero(self.scores > -np.inf)
        ids = self.ids[line, place]
        return pa.RecordBatch.from_arrays([pa.array(names[line].tolist(), name_type), pa.array(ids.tolist(), id_type), pa.array(self.scores[line, place])], names=["query_id", "id", "score"])


def _arrow(kind: str) -> pa.DataType:
    return pa.string() if kind == "string" else pa.int64()


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size == 0, 1, size)


def _scans(queries: DataFrame, size: int, scan: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """``scan`` of the questions, whose bytes are ``size``, in as many parts as are sent at once; None for too many parts."""
    if size > MOST_BYTES * MOST_SCANS:
        return None
    parts = -(-size // MOST_BYTES) or 1
    if parts == 1:
        return scan(queries)
    return reduce(DataFrame.unionByName, [scan(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)) for i in range(parts)])


def _dealt(corpus: DataFrame) -> DataFrame:
    """Each task gives k rows a question, so there are only some tasks for each core."""
    return corpus.coalesce(max(64, 4 * corpus.sparkSession.sparkContext.defaultParallelism))


def knn(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame | None:
    """query_id, id, score: each task's k best by cosine; None if the questions are too many to send."""
    spark = corpus.sparkSession
    asked = queries.where("embedding is not null")
    n, cells = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    name_kind, id_kind = kind_of(queries, "query_id"), kind_of(corpus, "id")
    schema = f"query_id {name_kind}, id {id_kind}, score double"
    if not n:
        return spark.createDataFrame([], schema)
    # Nulls are left out in the task: as a condition, they would have vectors that are computed computed twice.
    usable = _dealt(corpus.select(F.col("id").cast(id_kind).alias("id"), F.col("embedding").cast("array<double>").alias("v")))

    def search(asked: DataFrame) -> DataFrame:
        rows = asked.select(F.col("query_id").cast(name_kind).alias("query_id"), F.col("embedding").cast("array<double>").alias("v")).toArrow()
        names = np.array(rows.column(0).to_pylist(), object)
        sent = spark.sparkContext.broadcast(_unit(rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1)) if len(names) else np.empty((0, 0)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, step = Best(len(names), k, id_kind), max(1, CELLS // ROWS)
            for batch in batches if len(names) else ():
                batch = batch.filter(batch.column(1).is_valid())
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    vectors = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)).T
                    ids = np.array(part.column(0).to_pylist())
                    for first in range(0, len(names), step):
                        # Rounded, so that equal vectors tie whatever the block.
                        best.add(ids, np.round(sent.value[first : first + step] @ vectors, 9), first)
            yield best.batch(names, _arrow(name_kind), _arrow(id_kind))

        return usable.mapInArrow(scan, schema)

    return _scans(asked, 8 * cells, search)


@dataclass
class Terms:
    """The terms of all questions by question: those of question i are ``codes[at[i]:at[i + 1]]``, asked for ``times`` often."""

    names: np.ndarray
    terms: pa.Array
    at: np.ndarray
    codes: np.ndarray
    times: np.ndarray


def _asked(queries: DataFrame) -> tuple[DataFrame, int]:
    """(query_id, term, times) and the bytes of these."""
    asked = queries.select(F.col("query_id").cast(kind_of(queries, "query_id")).alias("query_id"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    return asked, asked.agg(F.coalesce(F.sum(TERM_BYTES + F.octet_length("term")), F.lit(0))).first()[0]


def _terms(asked: DataFrame) -> Terms:
    """Collects rows whose bytes ``_scans`` has bounded."""
    rows = asked.toArrow()
    names = pc.unique(rows.column(0)).sort()
    terms = pc.unique(rows.column(1)).sort()
    number, code = (pc.index_in(rows.column(i), value_set=known).to_numpy() for i, known in enumerate((names, terms)))
    order = np.lexsort((code, number))
    return Terms(np.array(names.to_pylist(), object), terms, np.searchsorted(number[order], np.arange(len(names) + 1)), code[order].astype(np.int64), rows.column(2).to_numpy()[order])


def _by_id(docs: DataFrame) -> DataFrame:
    return _dealt(docs.select(F.col("id").cast(kind_of(docs, "id")).alias("id"), tokens(F.col("text")).alias("words")))


def _counted(batch: pa.RecordBatch, terms: pa.Array, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, lengths, code, document, tf) of ``rows`` documents at a time: a triple for each asked term that a document holds."""
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        words = part.column(1)
        flat = words.flatten()
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = flat.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = known[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int64)
        doc = np.repeat(np.arange(part.num_rows), lengths)[code >= 0]
        code = code[code >= 0]
        ids = np.array(part.column(0).to_pylist())
        for at in range(0, part.num_rows, rows):
            lo, hi = np.searchsorted(doc, (at, at + rows))
            size = min(rows, part.num_rows - at)
            pair, tf = np.unique(code[lo:hi] * size + (doc[lo:hi] - at), return_counts=True)
            yield ids[at : at + size], lengths[at : at + size], pair // size, pair % size, tf


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places start, start + 1, ... of each run, and which run each is of."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(run)), run


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float, b: float, digits: int) -> DataFrame | None:
    """query_id, id, score: each task's k best by BM25; None if the questions are too many to send.

    The first scan counts documents, words and the documents of each term; the second scores. Scores are
    rounded before they are compared, so a later tie by id is not cut off here. Terms that many documents hold and
    many questions ask for are one matrix product; the pairs of a document and a question that share another term
    are added up one by one, so the work follows what they share and not the number of terms.
    """
    spark = docs.sparkSession
    asked, size = _asked(queries)
    name_kind, id_kind = kind_of(queries, "query_id"), kind_of(docs, "id")
    schema = f"query_id {name_kind}, id {id_kind}, score double"
    if not size:
        return spark.createDataFrame([], schema)
    held = _by_id(docs)

    def search(asked: DataFrame) -> DataFrame:
        terms = _terms(asked)
        n, n_terms, names, words = len(terms.names), len(terms.terms), terms.names, spark.sparkContext.broadcast(terms.terms)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, n_docs, n_words = np.zeros(n_terms, np.int64), 0, 0
            for batch in batches:
                for _, lengths, code, _, _ in _counted(batch, words.value, ROWS):
                    df += np.bincount(code, minlength=n_terms)
                    n_docs, n_words = n_docs + len(lengths), n_words + int(lengths.sum())
            seen = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *seen.tolist()], pa.int64()), pa.array([n_docs, n_words, *df[seen].tolist()], pa.int64())], names=["code", "n"])

        sums = held.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
        found = np.zeros(n_terms + 2)
        found[sums.column(0).to_numpy() + 2] = sums.column(1).to_numpy()
        n_docs, n_words, df = found[0], found[1], found[2:]
        average = (n_words / n_docs if n_docs else 0.0) or 1.0
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        # The same rows by term: those of code c are line[by[c]:by[c + 1]], each with its weight.
        owner = np.repeat(np.arange(n), np.diff(terms.at))
        order = np.argsort(terms.codes, kind="stable")
        line, weight = owner[order], (terms.times * idf[terms.codes])[order]
        by = np.searchsorted(terms.codes[order], np.arange(n_terms + 1))
        share = (df / max(n_docs, 1)) * (np.diff(by) / max(n, 1))
        most = max(1, MOST_BYTES // (8 * n))
        common = np.sort(np.argsort(-share, kind="stable")[: min(most, int((share >= COMMON).sum()))])
        sent = spark.sparkContext.broadcast((line, weight, by, common))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            line, weight, by, common = sent.value
            place = np.full(n_terms, -1)
            place[common] = np.arange(len(common))
            at, run = _spread(by[common], np.diff(by)[common])
            dense = np.zeros((n, len(common)))
            dense[line[at], run] = weight[at]
            best, rows = Best(n, k, id_kind), int(min(ROWS, max(16, CELLS // n)))
            for batch in batches:
                for ids, lengths, code, doc, tf in _counted(batch, words.value, rows):
                    value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / average))
                    often = place[code] >= 0
                    block = np.zeros((len(common), len(ids)))
                    block[place[code[often]], doc[often]] = value[often]
                    scores = (dense @ block).ravel()
                    code, doc, value = code[~often], doc[~often], value[~often]
                    sizes = by[code + 1] - by[code]
                    ends = np.cumsum(sizes)
                    for lo in range(0, int(ends[-1]) if len(ends) else 0, CELLS):
                        # As many pairs at once as a block has cells.
                        own = slice(np.searchsorted(ends, lo, "right"), np.searchsorted(ends, lo + CELLS, "right"))
                        at, run = _spread(by[code[own]], sizes[own])
                        scores += np.bincount(line[at] * len(ids) + doc[own][run], weight[at] * value[own][run], len(scores))
                    scores = np.round(scores.reshape(n, -1), digits)
                    best.add(ids, np.where(scores > 0, scores, -np.inf))
            yield best.batch(names, _arrow(name_kind), _arrow(id_kind))

        return held.mapInArrow(scan, schema)

    return _scans(asked, size, search)


def _holding(batch: pa.RecordBatch, words: pa.Array, at: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, question, document) of the documents that hold all terms of a question, found from its rarest term there."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for ids, _, code, doc, _ in _counted(batch, words, ROWS):
        df = np.bincount(code, minlength=len(words))
        order = np.lexsort((df[codes], owner))
        ranked = codes[order]  # each question's terms, the rarest first
        starts = np.searchsorted(code, np.arange(len(words) + 1))
        first, many = ranked[at[:-1]], np.diff(at)
        asked = np.flatnonzero(df[first])
        ends = np.cumsum(df[first[asked]])
        pair = code * len(ids) + doc
        for lo in range(0, int(ends[-1]) if len(ends) else 0, CELLS):
            own = asked[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, lo + CELLS, "right")]
            place, run = _spread(starts[first[own]], df[first[own]])
            line, held, nth = own[run], doc[place], 1
            done = []
            while len(line):
                over = many[line] == nth
                done.append((line[over], held[over]))
                line, held = line[~over], held[~over]
                wanted = ranked[at[line] + nth] * len(ids) + held
                found = np.searchsorted(pair, wanted)
                same = pair[np.minimum(found, len(pair) - 1)] == wanted
                line, held, nth = line[same], held[same], nth + 1
            if done:
                line, held = (np.concatenate(x) for x in zip(*done, strict=True))
                yield ids, line, held


def holding_all(docs: DataFrame, queries: DataFrame) -> DataFrame | None:
    """query_id, id of the documents that hold every term of a question; None if the questions are too many to send."""
    return _all_held(docs, queries, False)


def holding_counts(docs: DataFrame, queries: DataFrame) -> DataFrame | None:
    """query_id, n, first: how many documents of each task hold every term of a question, and the smallest id of these."""
    return _all_held(docs, queries, True)


def _all_held(docs: DataFrame, queries: DataFrame, counted: bool) -> DataFrame | None:
    spark = docs.sparkSession
    name_kind, id_kind = kind_of(queries, "query_id"), kind_of(docs, "id")
    schema = f"query_id {name_kind}, n long, first {id_kind}" if counted else f"query_id {name_kind}, id {id_kind}"
    asked, size = _asked(queries)
    held = _by_id(docs)

    def search(asked: DataFrame) -> DataFrame:
        terms = _terms(asked)
        names, sent = terms.names, spark.sparkContext.broadcast((terms.terms, terms.at, terms.codes))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, least = np.zeros(len(names), np.int64), np.zeros(len(names), "U1" if id_kind == "string" else np.int64)
            for batch in batches if len(names) else ():
                for ids, line, held in _holding(batch, *sent.value):
                    if not counted:
                        yield pa.RecordBatch.from_arrays([pa.array(names[line].tolist(), _arrow(name_kind)), pa.array(ids[held].tolist(), _arrow(id_kind))], names=["query_id", "id"])
                    elif len(line):
                        order = np.lexsort((ids[held], line))
                        head = np.flatnonzero(np.diff(line[order], prepend=-1))
                        own, names_held = line[order][head], ids[held[order][head]]
                        better = (n[own] == 0) | (names_held < least[own])
                        least = least.astype(np.promote_types(least.dtype, names_held.dtype), copy=False)
                        least[own[better]] = names_held[better]
                        n += np.bincount(line, minlength=len(n))
            if counted:
                found = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(names[found].tolist(), _arrow(name_kind)), pa.array(n[found]), pa.array(least[found].tolist(), _arrow(id_kind))], names=["query_id", "n", "first"])

        return held.mapInArrow(scan, schema)

    return _scans(asked, size, search)
