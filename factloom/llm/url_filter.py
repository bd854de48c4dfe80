"""URL rules by a sort-merge range join over reversed hosts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Keys of the sample from which the ranges are cut, for each range.
SAMPLE_PER_RANGE = 64
_LAST = chr(0x10FFFF)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = _rest(url)
    return _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for a null url or one without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def reversed_key(host: Column) -> Column:
    """``a.example.org`` → ``org.example.a.``: a rule's host and its subdomains share its key as prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep():
    """Walk rows in key order and keep a stack of the hosts whose intervals are open.

    Intervals of reversed hosts nest or are apart, so the stack always holds exactly the hosts that
    contain the current key. Each of its frames maps rule paths to rules.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
        held = None
        for frame in frames:
            out = []
            for part, key, kind, row, path, rule, verdict in zip(frame["part"], frame["key"], frame["kind"], frame["row"], frame["path"], frame["rule"], frame["verdict"], strict=True):
                if part != held:
                    held, stack = part, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    _, paths, lengths = stack[-1]
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                    # Of two rules for one host and path the smaller verdict ('allow') stands.
                    paths[path] = min(paths.get(path, (rule, verdict)), (rule, verdict))
                    continue
                best = None
                for open_key, paths, lengths in stack:
                    for length in lengths:
                        found = paths.get(path[:length]) if length <= len(path) else None
                        if found is not None:
                            rank = (len(found[0]), len(open_key))
                            if best is None or rank > best[0]:
                                best = (rank, found)
                            break
                out.append((row, best and best[1][0], best and best[1][1]))
            yield pd.DataFrame(out, columns=["row", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict; hosts are lower-cased (A-Z) as those of urls are, and a rule with a
    null in any of the three is left out. A rule fits its host and all subdomains where the url's path
    starts with the rule's. The rule of the longest ``host + path`` wins, then that of the longer host;
    of two verdicts for one rule the smaller string stands. Without a rule, rule is null and verdict is
    ``default``. Null urls and urls without ``://`` have an empty host and path. Repeated pages give
    repeated rows; null page_ids stay; other columns are not read. Without rules every page has the
    default; an empty pages table gives no rows.

    Pages are dealt into ranges of their reversed-host key (with a hash of the url behind it, so that
    one host may fill many ranges), and each rule goes to every range that its interval meets.
    """
    spark = pages.sparkSession
    count = partitions(spark)
    urls = pages.select("page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.hex(F.xxhash64("url", "page_id")).alias("salt"))
    keyed = urls.withColumn("key", reversed_key(F.col("host"))).withColumn("spread", F.concat("key", F.lit("\x00"), "salt"))
    bounds = _bounds(keyed.select("spread", F.xxhash64("salt").alias("order")), count)
    part_of = _place(bounds)
    row = F.struct("page_id", "host", "path")
    sides = keyed.select(part_of(F.col("spread")).alias("part"), "key", F.lit(1).alias("kind"), row.alias("row"), "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    clean = rules.where("host is not null and path is not null and verdict is not null").withColumn("host", _lower(F.col("host")))
    opened = clean.select(reversed_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    first, last = part_of(F.col("key")), part_of(F.concat("key", F.lit(_LAST)))
    spread_rules = opened.select(F.explode(F.sequence(first, last)).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast(sides.schema["row"].dataType).alias("row"), "path", "rule", "verdict")
    both = sides.unionByName(spread_rules).repartitionById(count, F.col("part") % F.lit(count)).sortWithinPartitions("part", "key", "kind")
    kind = dict(pages.dtypes)["page_id"]
    swept = both.mapInPandas(_sweep(), f"row struct<page_id:{kind},host:string,path:string>, rule string, verdict string")
    return swept.select("row.page_id", "row.host", "row.path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _bounds(keys: DataFrame, ranges: int) -> list[str]:
    """Cuts between ranges, from the keys of least hash, about ``SAMPLE_PER_RANGE`` for each range; they
    affect speed alone. Each task sends its share of these."""
    rows = keys.count()
    if not rows or ranges < 2:
        return []
    share = min(1.0, ranges * SAMPLE_PER_RANGE / rows)
    below = F.pmod("order", F.lit(1 << 30)) < max(1, round(share * (1 << 30)))
    sample = sorted(row[0] for row in keys.where(below).select("spread").collect())
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def _place(bounds: list[str]) -> Callable[[Column], Column]:
    """How many of the sorted bounds are not above a key: every step-th bound is tried first, then those between."""
    if not bounds:
        return lambda key: F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    strings = lambda values: F.array(*[F.lit(b) for b in values]).cast("array<string>")
    every, coarse = strings(bounds), strings(bounds[step - 1 :: step])
    upto = lambda values, key: F.size(F.filter(values, lambda b: b <= key))

    def place(key: Column) -> Column:
        blocks = upto(coarse, key) * step
        return blocks + upto(F.slice(every, blocks + 1, step - 1), key)

    return place
