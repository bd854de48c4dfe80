"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, small_batches

#: Pre-tokens a task remembers in each of two generations; older ones are encoded again.
REMEMBERED = 250_000
#: Pre-tokens of up to so many bytes share one queue; longer ones have their own.
SHORT = 256
#: Characters of text that are split at once.
RUN = 6_000_000


class RankQueue:
    """A priority queue of merge ranks for one pre-token.

    Each rank has a bucket of list positions. A bitmap in two levels tells which buckets hold
    something: ``leaves`` has a bit a rank in words of 256 bits, ``top`` a bit for each word that is
    not zero. The lowest set bit of ``top``, then of its leaf, is the next rank.
    """

    __slots__ = ("buckets", "leaves", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.leaves: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            leaf = rank >> 8
            self.leaves[leaf] = self.leaves.get(leaf, 0) | 1 << (rank & 255)
            self.top |= 1 << leaf
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]]:
        """The least rank and its positions."""
        leaf = (self.top & -self.top).bit_length() - 1
        word = self.leaves[leaf]
        low = word & -word
        word ^= low
        if word:
            self.leaves[leaf] = word
        else:
            del self.leaves[leaf]
            self.top ^= 1 << leaf
        rank = (leaf << 8) + low.bit_length() - 1
        return rank, self.buckets.pop(rank)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of a pre-token: always merge the pair of least rank, leftmost first.

    The parts are a doubly linked list over byte positions. A bucket's entry is stale, and skipped,
    when its part is gone or the pair that starts there now has another rank. Time is nearly linear
    in the length, so a pre-token of a million bytes is no special case.
    """
    n = len(piece)
    nexts, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [-1] * n
    queue = RankQueue()
    push, get = queue.push, ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            pair[i] = rank
            push(rank, i)
    while queue.top:
        rank, positions = queue.pop()
        positions.sort()
        for at, i in enumerate(positions):
            if pair[i] != rank:
                continue
            right = nexts[i]
            end = nexts[right]
            nexts[i] = end
            pair[right] = -1
            least = rank
            if end < n:
                before[end] = i
                new = get(piece[i : nexts[end]])
                if new is None:
                    pair[i] = -1
                else:
                    pair[i] = new
                    push(new, i)
                    least = min(least, new)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                new = get(piece[left:end])
                if new is None:
                    pair[left] = -1
                else:
                    pair[left] = new
                    push(new, left)
                    least = min(least, new)
            if least < rank:
                # A better rank has appeared; what is left of this bucket waits.
                for later in positions[at + 1 :]:
                    push(rank, later)
                break
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : nexts[i]]])
        i = nexts[i]
    return ids


class PairRanks:
    """Ranks of the tokens that two tokens make together, for arrays of pairs of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[key] for key in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks, or -1 where two tokens make none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], -1)


def _push_all(queue: RankQueue, ranks: np.ndarray, positions: np.ndarray) -> None:
    """Arrays of positions into the buckets of their ranks."""
    there = ranks >= 0
    ranks, positions = ranks[there], positions[there]
    if not len(ranks):
        return
    order = np.argsort(ranks, kind="stable")
    ranks, positions = ranks[order], positions[order]
    cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
    starts = [0, *cuts.tolist()]
    for rank, lo, hi in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
        queue.push(rank, positions[lo:hi])


def merge_many(pieces: list[bytes], pair_ranks: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many short pre-tokens, one after the other, and how many each has.

    One queue serves all of them: a bucket holds the positions of a rank in every pre-token. Of each
    pre-token only the leftmost live position is merged at a time; the others go back to the bucket,
    as a better rank may have appeared beside them.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(piece) for piece in pieces], np.int64)
    n = len(data)
    owner = np.repeat(np.arange(len(pieces)), lengths)
    ends = np.cumsum(lengths)
    token = pair_ranks.bytes[data]
    nexts = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    nexts[ends - 1] = -1
    before[ends - lengths] = -1
    pair = np.full(n, -1, np.int64)
    inner = np.flatnonzero(nexts >= 0)
    pair[inner] = pair_ranks(token[inner], token[inner + 1])
    alive = np.ones(n, bool)
    queue = RankQueue()
    _push_all(queue, pair[inner], inner)
    while queue.top:
        rank, arrays = queue.pop()
        at = arrays[0] if len(arrays) == 1 else np.unique(np.concatenate(arrays))
        at = at[pair[at] == rank]
        if not len(at):
            continue
        if len(at) > 1:
            own = owner[at]
            again = own[1:] == own[:-1]
            if again.any():
                queue.push(rank, at[1:][again])
                at = at[np.concatenate(([True], ~again))]
        right = nexts[at]
        end = nexts[right]
        token[at], nexts[at], pair[right], alive[right] = rank, end, -1, False
        pair[at] = -1
        more = end >= 0
        if more.any():
            here, there = at[more], end[more]
            before[there] = here
            pair[here] = pair_ranks(token[here], token[there])
        left = before[at]
        left = left[left >= 0]
        if len(left):
            pair[left] = pair_ranks(token[left], token[nexts[left]])
            at = np.concatenate((left, at))
        _push_all(queue, pair[at], at)
    return token[alive], np.bincount(owner[alive], minlength=len(pieces))


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks, self.words = ranks, {rank: word for word, rank in ranks.items()}
        self.pair_ranks = PairRanks(ranks)
        self.decimal = {rank: b"%d" % rank for rank in self.words}
        self.split = regex.compile(pattern).findall
        self.remembered, self.long = remembered, False
        # Of each pre-token seen lately: its ids in decimal, and what they decode to.
        self.ids: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.split(text) for i in self.encode_piece(piece)]

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        return [whole] if whole is not None else merge_bytes(data, self.ranks)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def _note(self, piece: str, ids: list[int]) -> None:
        self.ids[piece] = b" ".join(map(self.decimal.__getitem__, ids))
        self.raw[piece] = self.decode(ids)

    def learn(self, pieces: set[str]) -> None:
        """Encode and decode the pre-tokens that aren't remembered."""
        old_ids, old_raw = self.older
        short: list[tuple[str, bytes]] = []
        for piece in pieces:
            if piece in old_ids:
                self.ids[piece], self.raw[piece] = old_ids[piece], old_raw[piece]
                continue
            data = piece.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            if whole is not None:
                self._note(piece, [whole])
            elif len(data) > SHORT:
                self._note(piece, merge_bytes(data, self.ranks))
            else:
                short.append((piece, data))
        if short:
            tokens, counts = merge_many([data for _, data in short], self.pair_ranks)
            ends = np.cumsum(counts).tolist()
            tokens = tokens.tolist()
            for (piece, _), lo, hi in zip(short, [0, *ends], ends, strict=False):
                self._note(piece, tokens[lo:hi])

    def forget(self) -> None:
        """Drop long pre-tokens, and start a new generation when there are enough."""
        for piece in [piece for piece in self.ids if len(piece) > SHORT] if self.long else []:
            del self.ids[piece], self.raw[piece]
        if len(self.ids) > self.remembered:
            self.older = self.ids, self.raw
            self.ids, self.raw = {}, {}

    def forget_all(self) -> None:
        self.ids, self.raw, self.older = {}, {}, ({}, {})

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, SHA-256 of the ids in decimal, SHA-256 of the decoded bytes."""
        at = 0
        while at < len(texts):
            first, held = at, 0
            while at < len(texts) and held < RUN:
                held += len(texts[at])
                at += 1
            # One string for each different pre-token, however often it occurs in the run.
            shared: dict[str, str] = {}
            split = [list(map(shared.setdefault, found, found)) for found in map(self.split, texts[first:at])]
            pieces = shared.keys() - self.ids.keys()
            self.long = any(len(piece) > SHORT for piece in pieces)
            self.learn(pieces)
            ids_of, raw_of = self.ids.__getitem__, self.raw.__getitem__
            for own in split:
                ids = b" ".join(map(ids_of, own))
                yield ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join(map(raw_of, own))).hexdigest()
            self.forget()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


_encoders: dict[tuple[str, str], ByteBpe] = {}


def encoder(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file, made once in each Python process; the file is on every machine."""
    if (path, pattern) not in _encoders:
        with open(path, "rb") as file:
            _encoders[path, pattern] = ByteBpe(parse_ranks(file.read()), pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded text of every document; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [bpe.encode(text or "") for text in part.column(1).to_pylist()]
                decoded = [bpe.decode(x).decode("utf-8", "replace") for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, ids array<int>, decoded string")


def _digest_batches(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        try:
            for batch in batches:
                rows = list(bpe.digests([text or "" for text in batch.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        finally:  # the process stays for other stages; a task meets nearly all of its pre-tokens in its first batches
            bpe.forget_all()

    return run


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Whole texts are encoded, without special tokens, and the ids are decoded again. A null text
    counts as empty: no ids, and the hash of nothing. Repeated rows give repeated rows; doc_id may be
    null; other columns are not read. An empty table gives no rows.
    """
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return source.mapInArrow(give_back(_digest_batches(path, pattern)), f"doc_id {dict(source.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
