"""Mixing domains to target weights by soft membership, with DataFrame functions only.

A naive Bayes classifier, whose tables come from labelled rows, gives each document a posterior over
the domains. Document rates r >= 0 are then fitted so that the expected tokens of each domain,
sum(r * tokens * posterior), meet the targets: projected-gradient least squares whose only
communication is a few sums for each pair of domains and step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Bound of the labelled sample, documents a domain, and telling words that are known of each domain.
DOCS_PER_DOMAIN, WORDS_PER_DOMAIN = 300, 100
#: Evidence of a text is its mean log-likelihood times this, so that long texts stay soft.
SHARPNESS = 30.0
#: Domain weights are the domains' natural shares to this power, unless weights are given.
TEMPERATURE = 0.7
#: Targets count as met within this share of them, totals as standing still by the other; passes that a fit may need.
MET, STILL, PASSES = 5e-4, 1e-7, 500
#: Decimal places of posteriors. Documents of one rounded posterior share a rate.
PLACES = 4
_SPACE = r"[\x20\x09-\x0D]"


@dataclass
class Classifier:
    """Naive Bayes over a few telling words and all the rest together.

    ``tables[w][d]`` is the log-likelihood of word w in domain d; the last row is of other words.
    """

    domains: list[str]
    words: list[str]
    tables: list[list[float]]


def train(labelled: DataFrame, docs_per_domain: int = DOCS_PER_DOMAIN, words_per_domain: int = WORDS_PER_DOMAIN) -> Classifier:
    """Fit on ``labelled`` (doc_id, text, domain); null domains are left out.

    Of each domain at most ``docs_per_domain`` documents are used, those of least hash (of doc_id and text) in as many
    slots. A word tells a domain by how much more often it is there than in any other.
    """
    rows = labelled.where("domain is not null and text is not null").select(F.col("domain").cast("string").alias("domain"), "text", F.xxhash64("doc_id", "text").alias("hash"))
    slots = rows.select("domain", "hash").groupBy("domain", F.pmod("hash", F.lit(docs_per_domain)).alias("slot")).agg(F.min("hash").alias("hash"))
    # Bounded by docs_per_domain rows a domain.
    chosen = [(row.domain, row.hash) for row in slots.select("domain", "hash").collect()]
    if not chosen:
        return Classifier([], [], [])
    small = rows.sparkSession.createDataFrame(chosen, "domain string, hash long")
    # Repeated rows have one hash and are one row of the sample.
    one = rows.join(F.broadcast(small), ["domain", "hash"]).groupBy("domain", "hash").agg(F.min("text").alias("text"))
    sample = one.select("domain", F.explode(F.split("text", _SPACE)).alias("word")).where("word <> ''")
    counts = Scratch(rows.sparkSession, "words").store("words", sample.groupBy("domain", "word").agg(F.count(F.lit(1)).alias("n")))
    totals = {row[0]: row[1] for row in counts.groupBy("domain").agg(F.sum("n")).collect()}
    domains = sorted({domain for domain, _ in chosen})
    share = F.create_map(*[F.lit(x) for d in domains for x in (d, float(totals.get(d, 1)))])
    rates = counts.where("n >= 3").withColumn("rate", F.col("n") / share[F.col("domain")])
    by_word = rates.groupBy("word").agg(F.max(F.struct("rate", "domain")).alias("best"), F.sum("rate").alias("all"))
    telling = by_word.select("word", F.col("best.domain").alias("domain"), (2 * F.col("best.rate") - F.col("all")).alias("lead"))
    # The sample bounds the words of a domain, so one task may rank them.
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("lead"), "word"))
    top = telling.withColumn("rank", rank).where(F.col("rank") <= words_per_domain)
    vocabulary = [row.word for row in sorted(top.collect(), key=lambda row: (row.domain, row.rank))]
    found = {(row.domain, row.word): row.n for row in counts.where(F.col("word").isin(vocabulary)).collect()} if vocabulary else {}
    tables = [[math.log((found.get((d, w), 0) + 0.5) / (totals.get(d, 0) + len(vocabulary))) for d in domains] for w in vocabulary]
    rest = [math.log(max(1.0, totals.get(d, 0) - sum(found.get((d, w), 0) for w in vocabulary)) / (totals.get(d, 0) + len(vocabulary))) for d in domains]
    return Classifier(domains, vocabulary, [*tables, rest])


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """One row for each doc_id and text: doc_id, __text (hash), __rows, __n (tokens of a row), __p.

    __p is the posterior in the order of the domains, of one entry where the model has no domains.
    Words meet the model in a hash join with its vocabulary, whose size the training bounds, and only
    known ones are summed up, map-side. A text without words still gives a row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k = max(1, len(model.domains))
    rest = model.tables[-1] if model.domains else [0.0]
    # No word is empty: an empty piece at the front marks the row.
    split = docs.select("doc_id", F.xxhash64(text).alias("__text"), F.array_prepend(F.split(F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", ""), rf"{_SPACE}+"), "").alias("pieces"))
    words = F.size("pieces") - 1 - (F.element_at("pieces", 2) == "").cast("int")
    word = split.select("doc_id", "__text", words.cast("long").alias("words"), F.explode("pieces").alias("word"))
    fields = ", ".join(f"l{d} double" for d in range(k))
    known = [(w, *row) for w, row in zip(model.words, model.tables, strict=False)]
    known = docs.sparkSession.createDataFrame([("", *[0.0] * k), *known], f"word string, {fields}")
    sums = word.join(F.broadcast(known), "word").groupBy("doc_id", "__text", "words").agg(
        F.count_if(F.col("word") == "").alias("marks"), F.count(F.lit(1)).alias("known"), *[F.sum(f"l{d}").alias(f"l{d}") for d in range(k)]
    )
    # A text without words has two empty pieces.
    rows = F.when(F.col("words") == 0, F.col("marks") / 2).otherwise(F.col("marks")).cast("long")
    sums = sums.withColumn("__rows", rows).withColumn("all", F.col("words") * F.col("__rows"))
    others = F.col("all") - (F.col("known") - F.col("marks"))
    evidence = F.array(*[(F.col(f"l{d}") + others * rest[d]) * SHARPNESS / F.greatest(F.col("all"), F.lit(1)) for d in range(k)])
    powers = sums.withColumn("e", evidence).withColumn("e", F.transform("e", lambda x: F.exp(x - F.array_max("e"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return powers.select("doc_id", "__text", "__rows", F.col("words").alias("__n"), F.transform("e", lambda x: x / total).alias("__p"))


@dataclass
class Fit:
    """A document's rate is max(least, 1 + the scalar product of its posterior with ``moves``)."""

    moves: list[float]
    natural: list[float]
    targets: list[float]
    expected: list[float]
    passes: int

    @property
    def residual(self) -> float:
        """The largest distance of a domain's expected tokens from its target, as a share of the target."""
        return max((abs(e - t) / t for e, t in zip(self.expected, self.targets, strict=True) if t > 0), default=0.0)


def rate(moves: Sequence[float], least: float = 0.0) -> Column:
    """The rate of a document by its posterior __p: gradient steps summed up, then projected to ``least`` or more."""
    along = reduce(add, [F.get("__p", F.lit(i)) * move for i, move in enumerate(moves)], F.lit(1.0))
    return F.greatest(F.lit(float(least)), along)


def fit_rates(members: DataFrame, k: int, weights: Sequence[float] | None = None, least: float = 0.0) -> Fit:
    """Projected-gradient least squares over ``members`` (__rows, __n, __p).

    The objective is sum((expected - target)^2 / natural). Its gradient moves a rate by a scalar product with
    the document's posterior, so the sum of all steps is one number a domain and the projection to
    ``least`` or more follows when a rate is asked for: nothing is stored a document. A step is damped
    by the Gram matrix of the rates that are free to move, which the same pass sums up; a pass tries three
    dampings, and the one with the least objective stands if it lowers it. Rows of one posterior are
    summed up first, by a partial aggregate, and a pass is one aggregate over these.

    Targets are in proportion to ``weights`` and so large that no domain has to shrink. The fit ends when
    the targets are met, or when the totals stand still because the bound or the softness of the posteriors
    keeps them from the targets (see ``Fit.residual``). It never ends for another reason: if ``PASSES`` do
    not do, it raises an error.
    """
    scratch = Scratch(members.sparkSession, "profiles")
    tokens = F.sum(F.col("__rows") * F.col("__n")).cast("double").alias("__w")
    profiles = scratch.store("profiles", members.groupBy("__p").agg(tokens))
    weight, shares = F.col("__w"), [F.get("__p", F.lit(i)) for i in range(k)]
    triangle = [(i, j) for i in range(k) for j in range(i, k)]

    def totals(trials: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each trial the expected tokens of the domains and the Gram matrix of the free rates: one pass."""
        sums = []
        for moves in trials:
            own = rate(moves.tolist(), least)
            free = F.when(own > least, weight).otherwise(0.0)
            sums += [F.sum(own * weight * p) for p in shares] + [F.sum(free * shares[i] * shares[j]) for i, j in triangle]
        row = np.array([x or 0.0 for x in profiles.agg(*sums).first()]).reshape(len(trials), -1)
        found = []
        for values in row:
            gram = np.zeros((k, k))
            for (i, j), value in zip(triangle, values[k:], strict=True):
                gram[i, j] = gram[j, i] = value
            found.append((values[:k], gram))
        return found

    moves = np.zeros(k)
    ((expected, gram),) = totals([moves])
    natural = np.array([x or 0.0 for x in profiles.agg(*[F.sum(weight * p) for p in shares]).first()])
    wanted = np.array(weights, float) if weights is not None else natural**TEMPERATURE
    there = (natural > 0) & (wanted > 0)
    targets = np.where(natural > 0, wanted * (natural[there] / wanted[there]).max(), 0.0) if there.any() else np.zeros(k)
    passes, damping, still = 0, 1.0, 0
    off = lambda totals: float((((totals - targets) ** 2)[natural > 0] / natural[natural > 0]).sum())
    apart = lambda a, b: float((np.abs(a - b)[targets > 0] / targets[targets > 0]).max(initial=0.0))
    none = (targets == 0) & (natural > 0)
    while there.any() and still < 2 and (apart(expected, targets) > MET or (expected[none] > MET * natural[none]).any()):
        passes += 1
        if passes > PASSES:
            raise RuntimeError(f"rates do not settle in {PASSES} passes: expected {expected.tolist()} of {targets.tolist()}")
        dampings = [damping * x for x in (0.1, 1.0, 10.0)]
        scale = np.maximum(natural, 1.0)
        trials = [moves + np.linalg.solve(gram + d * np.diag(scale), targets - expected) for d in dampings]
        found = totals(trials)
        best = min(range(len(trials)), key=lambda i: off(found[i][0]))
        moved = apart(found[best][0], expected)
        if off(found[best][0]) <= off(expected):
            moves, (expected, gram), damping = trials[best], found[best], max(1e-9, dampings[best])
        else:
            damping *= 1000
        still = still + 1 if moved < STILL else 0
    scratch.drop("profiles")
    return Fit(moves.tolist(), natural.tolist(), targets.tolist(), expected.tolist(), passes)


def _rated(docs: DataFrame, domain: str, weights: dict[str, float] | None, least: float) -> tuple[DataFrame, list[str]]:
    """Posteriors with the fitted rate as ``rate``, and the domains."""
    source = docs.select("doc_id", "text", F.col(domain).alias("domain"))
    model = train(source)
    scratch = Scratch(docs.sparkSession, "members")
    rounded = posteriors(source, model).withColumn("__p", F.transform("__p", lambda p: F.round(p, PLACES)))
    members = scratch.store("members", rounded)
    chosen = weights and [weights.get(d, 0.0) for d in model.domains]
    if not model.domains:
        return members.withColumn("rate", F.lit(1.0)), model.domains
    fit = fit_rates(members, len(model.domains), chosen, least)
    return members.withColumn("rate", F.round(rate(fit.moves, least), 6)), model.domains


def rates(docs: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, least: float = 0.0) -> DataFrame:
    """One row per document: doc_id, n_tokens, domain (likeliest), posterior (``PLACES`` places), rate (6 places).

    ``domain`` names the column that labels documents; rows where it is null get their posterior from
    their text alone, like all others. Null and empty texts have no tokens: equal posteriors and a rate
    by them, without effect on any total. Of tied posteriors the first domain by name is the likeliest.
    Repeated rows give repeated rows, each counted in the totals; a null doc_id is a value like others.
    Without any label every document has rate 1 and a null domain. Other columns are not read. An empty
    table gives no rows.
    """
    rated, domains = _rated(docs, domain, weights, least)
    names = F.array(*[F.lit(d) for d in domains]) if domains else F.array(F.lit(None).cast("string"))
    likeliest = F.get(names, F.array_position("__p", F.array_max("__p")).cast("int") - 1)
    return rated.select(
        "doc_id", F.col("__n").alias("n_tokens"), likeliest.alias("domain"), F.col("__p").alias("posterior"), "rate",
        F.explode(F.array_repeat(F.lit(1), F.col("__rows").cast("int"))).alias("row"),
    ).drop("row")


def mix(docs: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, least: float = 0.0, seed: int = 17) -> DataFrame:
    """The documents, each as often as its rate says; columns unchanged.

    The whole part of a rate is a number of copies; the rest is one more copy for the documents whose
    hashed doc_id falls below it, the same in every run. With ``least`` = 1 no document is lost.
    """
    rated, _ = _rated(docs, domain, weights, least)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    often = F.floor("rate").cast("int") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    times = rated.select(F.col("doc_id").alias("__id"), F.col("__text").alias("__same"), often.alias("__times"))
    keyed = docs.withColumn("__text", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found = keyed.join(times, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__same")))
    return found.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times")))).select(docs.columns)
