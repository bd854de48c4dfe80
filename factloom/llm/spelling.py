"""Spelling variants: a relational trie, walked level by level by joins, links words one edit apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Shortest word, fewest occurrences, how often a form outnumbers its variant, and which runs lose a letter.
LEAST_CHARS, LEAST_COUNT, RATIO, EVERY = 7, 2, 10, 31
#: Longest word that the trie holds: its masks of lengths are 64-bit numbers, its nodes prefixes.
LONGEST = 48
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): lower-cased runs of letters, of which a hash of document and run takes a letter from one in ``every``."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # A run that is too short before it loses a letter is too short after.
    runs = docs.select(own.alias("own"), F.explode(F.regexp_extract_all(text, F.lit(f"([a-zÀ-ÿ]{{{least_chars},}})"), F.lit(1))).alias("run"))
    marked = runs.select("run", F.crc32(F.concat("own", F.lit(":"), "run").cast("binary")).alias("mark"))
    place = F.pmod("mark", F.length("run").cast("long")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run")))
    words = marked.select(F.when(F.col("mark") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _char(place: Column) -> Column:
    return F.col("word").substr(place + 1, F.lit(1))


def _bit(mask: Column, n: Column) -> Column:
    """Whether words of n further letters lie below, by the mask of their lengths."""
    return F.call_function("shiftright", mask, n.cast("int")).bitwiseAND(1) == 1


def _walkers(words: DataFrame) -> DataFrame:
    """(word, back, start): each word as read from either end, and where it may first be edited.

    An edit in the second half leaves the first half as it is, so words start on their own path at the middle; one
    in the first half is found by the same walk from the other end. Words of under four letters have no halves.
    """
    size = F.length("word")
    half = F.when(size >= 4, F.floor(size / 2)).otherwise(F.lit(0)).cast("int")
    ahead = words.select("word", F.lit(False).alias("back"), half.alias("start"))
    return ahead.unionByName(words.select(F.reverse("word").alias("word"), F.lit(True).alias("back"), (size - half).alias("start")))


def _edges(scratch: Scratch, walkers: DataFrame, least: int) -> DataFrame:
    """(depth, back, node, letter, mask, below): the tries from depth ``least`` on; a node is a prefix.

    ``mask`` has a bit for each number of letters that words below the edge still have; ``below`` counts
    these words. Written by depth, so that a level reads its own edges only.
    """
    cut = F.explode(F.sequence(F.lit(least), F.length("word") - 1)).alias("depth")
    steps = walkers.where(F.length("word") > least).select("word", "back", cut).select("depth", "back", F.col("word").substr(F.lit(1), F.col("depth")).alias("node"), _char(F.col("depth")).alias("letter"), (F.length("word") - F.col("depth") - 1).alias("left"))
    edges = steps.groupBy("depth", "back", "node", "letter").agg(F.bit_or(F.expr("shiftleft(1L, left)")).alias("mask"), F.count(F.lit(1)).alias("below"))
    path = scratch.paths["edges"] = f"{scratch.root}/edges"
    edges.write.option("compression", "zstd").partitionBy("depth").parquet(path)
    return scratch.spark.read.schema("back boolean, node string, letter string, mask long, below long, depth int").parquet(path)


def _trie_links(scratch: Scratch, words: DataFrame) -> list[DataFrame]:
    """Tables of (a, b): words one replaced letter apart, and words with one letter less.

    A state is a word, the place up to which it is read, the node reached and the edits so far. States without an
    edit stand on the word's own path and branch: to a later letter of the node (a replacement; the other word
    does not find the pair again) or past a letter of the word (of equal letters in a row, the last of the word). States
    with an edit follow the word's remaining letters. A state ends where no word below its node has the remaining
    length, and a path with one word below does not branch. So each pair is found once.

    A level is two equi-joins with the edges of its depth. A node has 90 edges at most, so states multiply by
    that at most; a node with many states is split by adaptive execution as its edges are few.
    """
    walkers = scratch.store("walkers", _walkers(words))
    ends = walkers.agg(F.min("start"), F.max(F.length("word"))).first()
    if ends[0] is None:
        return []
    edges = _edges(scratch, walkers, ends[0])
    rest, letter = F.length("word") - F.col("place"), _char(F.col("place"))
    columns, waiting = ["word", "back", "place", "node", "mask"], None
    found = []
    for depth in range(ends[0], ends[1]):
        # Which lengths lie below the node where a word starts is only known after the next join; no word ends there.
        begun = walkers.where(F.col("start") == depth).select("word", "back", F.col("start").alias("place"), F.col("word").substr(F.lit(1), F.col("start")).alias("node"), F.lit(-2).cast("long").alias("mask"))
        clean = begun if waiting is None else begun.unionByName(waiting.where("edits = 0").select(columns))
        beside = F.when(F.col("back"), F.when(F.col("place") > 0, _char(F.col("place") - 1)).otherwise(F.lit(""))).otherwise(_char(F.col("place") + 1))
        skipped = clean.where((letter != beside) & _bit(F.col("mask"), rest - 1)).withColumn("place", F.col("place") + 1)
        follow = skipped if waiting is None else skipped.unionByName(waiting.where("edits = 1").select(columns))
        here = edges.where(F.col("depth") == depth).select(F.col("back").alias("from"), F.col("node").alias("at"), F.col("letter").alias("by"), F.col("mask").alias("mask_on"), "below")
        same = (F.col("back") == F.col("from")) & (F.col("node") == F.col("at"))
        fits = _bit(F.col("mask_on"), rest - 1)
        straight = follow.where(F.col("place") < F.length("word")).join(here, same & (letter == F.col("by"))).where(fits).withColumn("edits", F.lit(1))
        forked = clean.join(here, same & (((F.col("by") == letter) & (F.col("below") > 1)) | ((F.col("by") > letter) & fits))).withColumn("edits", F.when(F.col("by") == letter, 0).otherwise(1))
        moved = straight.unionByName(forked).select("word", "back", (F.col("place") + 1).alias("place"), F.concat("node", "by").alias("node"), F.col("mask_on").alias("mask"), "edits")
        stored = scratch.store(f"level-{depth}", moved)
        done = F.col("place") == F.length("word")
        pair = [F.when(F.col("back"), F.reverse(side)).otherwise(F.col(side)).alias(name) for side, name in (("word", "a"), ("node", "b"))]
        found += [stored.where(done & (F.col("edits") == 1)).select(pair), skipped.where(done).select(pair)]
        waiting = stored.where(~done)
    return found


def _long_links(words: DataFrame) -> DataFrame:
    """(a, b) among words too long for the trie: equal once a letter is taken from one or both.

    Each word sends the hash of itself and of itself without each letter: as many rows as it has letters. Rows
    that meet are compared letter by letter.
    """
    cut = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")).where((F.col("at") == 1) | (F.col("word").substr(F.col("at") - 1, F.lit(1)) != F.col("word").substr(F.col("at"), F.lit(1))))
    less = F.concat(F.col("word").substr(F.lit(1), F.col("at") - 1), F.col("word").substr(F.col("at") + 1, F.length("word")))
    keys = cut.select("word", F.xxhash64(less).alias("key"), F.col("at").alias("cut"))
    swapped = keys.select(F.col("word").alias("a"), "key").join(keys.select(F.col("word").alias("b"), "key"), "key").where("a < b and length(a) = length(b)").where(F.levenshtein("a", "b", 1) == 1)
    whole = words.select(F.col("word").alias("b"), F.xxhash64("word").alias("key"))
    dropped = keys.withColumnRenamed("word", "a").join(whole, "key").where("concat(substr(a, 1, cut - 1), substr(a, cut + 1)) = b")
    return swapped.select("a", "b").unionByName(dropped.select("a", "b")).distinct()


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), each pair of words one inserted, deleted or replaced letter apart once."""
    found = _trie_links(scratch, words.select("word").where(F.length("word") <= LONGEST))
    late = words.select("word").where(F.length("word") >= LONGEST)
    if not late.isEmpty():
        # Pairs of words of LONGEST letters each are the trie's.
        found.append(_long_links(late).where((F.length("a") > LONGEST) | (F.length("b") > LONGEST)))
    out = words.sparkSession.createDataFrame([], "a string, b string")
    for rows in found:
        out = out.unionByName(rows)
    return out


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int = EVERY) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the smallest), if that n is at least ``ratio`` times
    the word's; root follows forms to the last. Null texts have no words, a null doc_id counts as an empty
    string in the hash, repeated rows count each, an empty table gives no rows; only doc_id and text are read. Words of
    more than ``LONGEST`` letters do not fit the trie's masks and meet by the hashes of their shortened forms.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.store("words", word_counts(docs, least_chars, least_count, every))
    links = scratch.store("links", near_words(words, scratch))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("near")))
    near = both.join(words.toDF("b", "n"), "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    judged = words.join(near.withColumnRenamed("a", "word"), "word", "left")
    formed = F.col("best.near").isNotNull() & (-F.col("best.less") >= ratio * F.col("n"))
    table = scratch.store("forms", judged.select("word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("best.less")).alias("form_n")))
    roots = _roots(scratch, table.where("form is not null").select("word", F.col("form").alias("root")))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """Forms followed to the last: each step doubles the reach, and n grows along the way, so there is no cycle."""
    hops, step = scratch.store("roots-0", forms), 0
    while True:
        onward = hops.toDF("root", "further")
        step += 1
        moved = scratch.store(f"roots-{step}", hops.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        hops = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return hops
