"""MinHash-style near-duplicates: SetSketch bands propose, exact set comparison decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing, setsketch
from .common import FURTHER, Scratch, give_back, maybe_in, partitions, small_batches, without
from .components import connected_components

#: An estimate this far below the threshold (over six standard errors) ends a pair without comparing sets.
ESTIMATE_MARGIN = 0.22
#: Bands are compared in blocks of at most BLOCK members and about BLOCK_SHINGLES shingles.
BLOCK, BLOCK_SHINGLES = 1000, 1 << 20
#: Pairs of sketches that are compared at once.
AT_ONCE = 4096


def _digests(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two sums of mixed shingle hashes, 128 bits in all, which stand for the set."""
    both = [(hashing.mix(x).sum(dtype=np.uint64), hashing.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for x in sets]
    return tuple(pa.array(np.array([d[i] for d in both], np.uint64).view(np.int64)) for i in (0, 1))


def _sketch_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in hashing.by_bytes(batch.column("text").to_pylist()):
                own = batch.slice(at, len(texts))
                at += len(texts)
                sets = hashing.shingle_sets(texts, k)
                keys = setsketch.band_keys(setsketch.registers(np.stack([setsketch.minima(x) for x in sets]))).view(np.int64)
                columns = [own.column("doc_id"), own.column("text_key"), pa.array([len(x) for x in sets], pa.int64()), *_digests(sets), pa.array(list(keys), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands"])

    return run


def pack(values: np.ndarray) -> bytes:
    """A sorted set as bytes: differences, the most significant bytes of all first, which compress well."""
    steps = np.diff(values, prepend=np.uint64(0)).astype(">u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(">u8").ravel()
    return np.cumsum(steps.astype(np.uint64), dtype=np.uint64)


def _set_batches(k: int):
    """Sets and registers of the candidates, which pairs are then judged by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in hashing.by_bytes(batch.column("text").to_pylist()):
                own = batch.slice(at, len(texts))
                at += len(texts)
                sets = hashing.shingle_sets(texts, k)
                regs = [setsketch.registers(setsketch.minima(x)).tobytes() for x in sets]
                columns = [own.column("doc_id"), *_digests(sets), pa.array(regs, pa.binary()), pa.array([pack(x) for x in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "set_a", "set_b", "regs", "shingles"])

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, setsketch.REGISTERS)


def _likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether the joint estimates of pairs of sketches reach ``least``."""
    return setsketch.joint_estimate(a, b, n_a.astype(float), n_b.astype(float)) >= least


def _estimate_batches(least: float):
    """Keep the pairs whose joint estimate reaches ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                near = _likely(_sketches(part.column("regs_a")), _sketches(part.column("regs_b")), part.column("n_a").to_numpy(), part.column("n_b").to_numpy(), least)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(near)) for c in ("a", "b")], names=["a", "b"])

    return run


def _exact_batches(percent: int):
    """Keep the pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, held, unpacked = [], None, None
            for a, b in zip(batch.column("shingles_a"), batch.column("shingles_b"), strict=True):
                if held is None or a != held:
                    held, unpacked = a, unpack(a.as_py())
                other = unpack(b.as_py())
                found = np.searchsorted(unpacked, other)
                shared = int((unpacked[np.minimum(found, len(unpacked) - 1)] == other).sum()) if len(unpacked) else 0
                linked.append(100 * shared >= percent * (len(unpacked) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(linked, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return run


def shared_counts(some: list[np.ndarray], every: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many shingles each of ``some`` shares with each of ``every``: products of 0/1 matrices, a
    run of shingles at a time, over the shingles that both sides have."""
    wanted = np.unique(np.concatenate(some))
    counts = np.zeros((len(some), len(every)), np.float32)
    sides = []
    for sets in (some, every):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        values = np.concatenate(sets)
        at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
        there = wanted[at] == values
        order = np.argsort(at[there], kind="stable")
        sides.append((at[there][order], owner[there][order], len(sets)))
    for low in range(0, len(wanted), columns):
        halves = []
        for at, owner, n in sides:
            lo, hi = np.searchsorted(at, [low, low + columns])
            half = np.zeros((n, columns), np.float32)
            half[owner[lo:hi], at[lo:hi] - low] = 1
            halves.append(half)
        counts += halves[0] @ halves[1].T
    return counts


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole cells (band, i, j), by which rows are sorted, and where each cell starts and ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("band", "i", "j")], 1)
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("band", "i", "j")):
            new = np.concatenate([[0], new])
        if len(new):
            yield _whole([*held, batch.slice(0, new[-1])])
            held, batch = [], batch.slice(new[-1])
        held.append(batch)
    if held:
        yield _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
    batch = pa.concat_batches(parts)
    keys = np.stack([batch.column(c).to_numpy() for c in ("band", "i", "j")], 1)
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
    return batch, np.concatenate([[0], cuts, [batch.num_rows]]).astype(np.int64)


def _cell_pairs(left: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs (left row, other row) of each cell, at most AT_ONCE of them at a time."""
    some: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        own, rest = lo + np.flatnonzero(left[lo:hi]), lo + np.flatnonzero(~left[lo:hi])
        for at in range(0, len(own) * len(rest), AT_ONCE):
            pair = np.arange(at, min(at + AT_ONCE, len(own) * len(rest)))
            some.append((own[pair // len(rest)], rest[pair % len(rest)]))
            held += len(pair)
            if held >= AT_ONCE:
                yield tuple(np.concatenate(x) for x in zip(*some, strict=True))
                some, held = [], 0
    if some:
        yield tuple(np.concatenate(x) for x in zip(*some, strict=True))


def _screen_batches(percent: int):
    """The members of each cell that have a pair there which only their sets can decide.

    A pair counts in the first band where its sketches meet, if its sizes may be similar, its components
    differ and its joint estimate is near the threshold. Of two members outside the band's main
    component the smaller one's row leads.
    """
    least = percent / 100 - ESTIMATE_MARGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in cells(batches):
            node, n, component = (batch.column(c).to_numpy() for c in ("node", "n_shingles", "component"))
            left, apart = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("left", "apart"))
            regs = _sketches(batch.column("regs"))
            number = (setsketch.band_keys(regs).view(np.int64) == batch.column("band").to_numpy()[:, None]).argmax(1)
            wanted = np.zeros(len(node), bool)
            for a, b in _cell_pairs(left, bounds):
                fit = (component[a] != component[b]) & ~(apart[b] & (node[a] > node[b])) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                a, b = a[fit], b[fit]
                met = (regs[a] == regs[b]).reshape(len(a), setsketch.BANDS, setsketch.BAND_ROWS).all(2)
                first = met.argmax(1) == number[a]
                a, b = a[first], b[first]
                near = _likely(regs[a], regs[b], n[a], n[b], least)
                wanted[a[near]] = True
                wanted[b[near]] = True
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(wanted)) for c in SCREENED], names=list(SCREENED))

    return run


SCREENED = ("band", "i", "j", "node", "component", "left")


def _compare_batches(percent: int):
    """A spanning forest of the links between the left rows and the others of each cell, by their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in cells(batches):
            node, component, left = batch.column("node").to_numpy(), batch.column("component").to_numpy(), batch.column("left").to_numpy(zero_copy_only=False)
            ends: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                own, rest = lo + np.flatnonzero(left[lo:hi]), lo + np.flatnonzero(~left[lo:hi])
                if not len(own) or not len(rest):
                    continue
                some, every = ([unpack(batch.column("shingles")[int(at)].as_py()) for at in side] for side in (own, rest))
                shared = shared_counts(some, every)
                sizes = [np.array([len(x) for x in side]) for side in (some, every)]
                near = 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)
                a, b = np.nonzero(near & (component[own][:, None] != component[rest][None, :]))
                for end, found in zip(ends, _forest(node[own[a]], node[rest[b]]), strict=True):
                    end.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *end]), pa.int64()) for end in ends], names=["a", "b"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each end of the links (a, b) with the least node that they reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def _similar_sizes(small: Column, large: Column, percent: int) -> Column:
    return F.least(small, large) * 100 >= F.greatest(small, large) * percent


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _judged(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per document: doc_id, text_key (hash of the text), n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = texts.withColumn("text_key", _text_key())
    rows = scratch.store("rows", keyed.mapInArrow(give_back(_sketch_batches(k)), "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>"))

    # A node for each doc_id and set: the doc_id, or for a further set of that doc_id a number above all doc_ids.
    digest = F.struct("set_a", "set_b")
    by_id = rows.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("first"), F.max(digest).alias("last"), F.count(F.lit(1)).alias("n"))
    repeated = scratch.store("repeated", by_id.where("n > 1").select("doc_id", "first", "last"))
    again = not repeated.isEmpty()
    several = repeated.where("first <> last").select("doc_id", "first")

    def with_node(df: DataFrame) -> DataFrame:
        if not again:
            return df.withColumn("node", F.col("doc_id"))
        further = F.lit(FURTHER) + F.xxhash64("doc_id", "set_a", "set_b").bitwiseAND(F.lit(FURTHER - 1))
        return df.join(several, "doc_id", "left").withColumn("node", F.when(F.col("first") != digest, further).otherwise(F.col("doc_id"))).drop("first")

    sets = with_node(rows.where("n_shingles > 0 and doc_id is not null"))

    # Classes of equal sets.
    key = ["set_a", "set_b", "n_shingles"]
    classes = sets.groupBy(key).agg(F.min("node").alias("rep"), F.max("node").alias("last"))
    shared = scratch.store("shared", classes.where("rep <> last").drop("last"))
    copies = scratch.store("copies", maybe_in(sets.select("node", *key), "set_a", shared).join(shared, key).where("node <> rep").groupBy("node").agg(F.min("rep").alias("rep")))

    # Bands that several classes share, and the members of these, copies aside.
    bands = sets.select("node", "set_a", "n_shingles", F.explode("bands").alias("band"))
    crowded = scratch.store("crowded", bands.groupBy("band").agg(F.min("set_a").alias("low"), F.max("set_a").alias("high")).where("low <> high").select("band"))
    met = maybe_in(bands.drop("set_a"), "band", crowded).join(crowded, "band").join(copies.select("node"), "node", "left_anti")
    met = scratch.store("met", met.groupBy("band", "node").agg(F.first("n_shingles").alias("n_shingles")))
    sizes = met.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = scratch.store("members", met.join(sizes, "band"))
    candidates = scratch.store("candidates", members.groupBy("node").agg(F.sum("size").alias("weight")))
    scratch.drop("shared", "crowded", "met")

    # Sets and registers of the candidates; no text is shuffled.
    owners = candidates.select(F.col("node").alias("doc_id"))
    if again:
        owners = with_node(rows.select("doc_id", "set_a", "set_b")).join(candidates, "node", "left_semi").select("doc_id")
    found = with_node(maybe_in(texts.where("doc_id is not null"), "doc_id", owners).mapInArrow(give_back(_set_batches(k)), "doc_id long, set_a long, set_b long, regs binary, shingles binary"))
    found = found.select("node", "regs", "shingles")
    full = scratch.store("full", found.dropDuplicates(["node"]) if again else found)

    # First links: each crowded band to its most central class, the one that shares most bands.
    centre = members.join(candidates, "node").groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "n_shingles")).alias("best"))
    centre = scratch.store("centre", centre.select("band", (-F.col("best.minus")).alias("a"), F.col("best.n_shingles").alias("n_a")))
    pairs = members.join(centre, "band").where(F.col("a") != F.col("node")).where(_similar_sizes(F.col("n_shingles"), F.col("n_a"), percent))
    pairs = scratch.store("pairs", pairs.groupBy("a", F.col("node").alias("b")).agg(F.first("n_a").alias("n_a"), F.first("n_shingles").alias("n_b")))
    regs = full.select("node", "regs")
    joined = pairs.join(regs.toDF("b", "regs_b"), "b").join(regs.toDF("a", "regs_a"), "a").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    likely = scratch.store("likely", joined.mapInArrow(give_back(_estimate_batches(percent / 100 - ESTIMATE_MARGIN)), "a long, b long"))
    held = full.select("node", "shingles")
    joined = likely.join(held.toDF("b", "shingles_b"), "b").join(held.toDF("a", "shingles_a"), "a").select("a", "b", "shingles_a", "shingles_b")
    links = scratch.store("links", joined.mapInArrow(give_back(_exact_batches(percent)), "a long, b long"))
    scratch.drop("centre", "pairs", "likely")

    links = links.unionByName(_rest(scratch, members, full, links, percent))
    final = scratch.store("final", connected_components(links).toDF("rep", "component"))
    scratch.drop("full", "members", "candidates", "links", "rest-links")

    named = with_node(rows.drop("bands")).select("doc_id", "text_key", "n_shingles", "node").join(copies, "node", "left")
    named = named.withColumn("rep", F.coalesce("rep", "node")).join(final, "rep", "left").withColumn("least", F.coalesce("component", "rep"))
    component, first = F.col("least"), F.col("least")
    if again:  # where a component has a further text, its smallest doc_id may be that text's
        mixed = named.where(F.col("node") >= FURTHER).select("least").distinct()
        best = named.join(mixed, "least").groupBy("least").agg(F.min(F.struct("doc_id", "node")).alias("best"))
        named = named.join(best, "least", "left")
        component, first = F.coalesce("best.doc_id", "least"), F.coalesce("best.node", "least")
    kept = F.coalesce(F.col("node") == first, F.lit(True))
    return named.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def _rest(scratch: Scratch, members: DataFrame, full: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between members of a band that the first links left in different components.

    Members outside a band's main component (the one with most members) are compared with all members,
    in cells of two blocks, whatever the band's size. Sketches go first and name the rows of a cell
    whose pairs need their sets; only these rows' sets follow.
    """
    joined = scratch.store("joined", connected_components(links).toDF("node", "component"))
    placed = members.join(joined, "node", "left").select("band", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    placed = scratch.store("placed", placed)
    parts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("volume"))
    split = parts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size"), F.sum("volume").alias("volume")).where("parts > 1")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("volume") / BLOCK_SHINGLES, F.lit(1)))
    own = F.ceil(F.col("blocks") * (F.col("size") - F.col("main.n")) / F.col("size"))
    split = split.withColumn("blocks", blocks.cast("int")).select("band", F.col("main.component").alias("main"), "blocks", own.cast("int").alias("own"))
    rest = placed.join(scratch.store("split", split), "band").withColumn("apart", F.col("component") != F.col("main"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shown = ["node", "n_shingles", "component", "apart"]
    left = rest.where("apart").select("band", block("own").alias("i"), every("blocks").alias("j"), *shown, F.lit(True).alias("left"))
    right = rest.select("band", every("own").alias("i"), block("blocks").alias("j"), *shown, F.lit(False).alias("left"))
    cell, count = ["band", "i", "j"], partitions(members.sparkSession)
    dealt = left.unionByName(right).join(full.select("node", "regs"), "node").repartition(count, *cell).sortWithinPartitions(*cell)
    screened = scratch.store("screened", dealt.mapInArrow(give_back(_screen_batches(percent)), "band long, i int, j int, node long, component long, left boolean"))
    scratch.drop("joined", "placed", "split")
    dealt = screened.join(full.select("node", "shingles"), "node").repartition(count, *cell).sortWithinPartitions(*cell)
    found = scratch.store("rest-links", dealt.mapInArrow(give_back(_compare_batches(percent)), "a long, b long"))
    scratch.drop("screened")
    return found


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= ``percent`` * |union| of their shingle sets.
    Equal sets are one class, by its smallest doc_id, and only classes are compared. Each band with
    several classes proposes links to its most central class; what these leave in different components
    is then compared block by block, so no proposed link is lost and no large group is written out as
    pairs. A pair is given up before its sets are compared only if its joint estimate is below the
    threshold by ``ESTIMATE_MARGIN``.

    Shingles stand for themselves by 64-bit hashes and whole sets by 128-bit digests: two different sets
    have one digest with a chance of about 2 ** -128 a pair, and two different shingles of a compared
    pair one hash with a chance of 2 ** -64 each, which neither words nor bytes check afterwards.

    Texts that are null or without words link with nothing. Rows with a null doc_id can't be linked:
    their component is null and they are kept. Rows that repeat a doc_id and its set count as one
    document; another set under that doc_id is a document of its own, with links of its own, and kept or
    not by itself. Other columns are not read. An empty table gives no rows.
    """
    return _judged(docs, shingle_words, percent).drop("text_key")


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: the smallest doc_id of each component stays; columns unchanged.

    A row is dropped by its doc_id and text, so that another text of that doc_id is judged by itself.
    """
    dropped = _judged(docs, shingle_words, percent).where("not kept").select("doc_id", "text_key")
    return without(docs, dropped, _text_key())
