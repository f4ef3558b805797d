"""Mixing documents to target weights by soft domain membership.

DataFrame functions only. A table of labels gives some documents a domain: toxic, else clean or low by quality. A
naive Bayes classifier over the different words of a text, fitted on a bounded sample of labelled documents
(PER_DOMAIN of each domain, copies of a text once), gives every document its evidence: log odds of each domain against the first. Texts of about equal
evidence are a cell, and the shares of domains in the cell, as the sample has them, are the posteriors p, to DIGITS decimals. With n its tokens, a
document of rate r is expected to give r n p_k tokens to domain k.

Rates r >= 0 make the expected totals A r meet targets t: scaled projected gradient descent, from r = 1, on the
least squares |A r - t|^2 in the metric of the Gram matrix G = sum n p p' of the documents whose rate isn't 0. A step takes
p . G^-1 (A r - t) from each rate and projects at 0. A rate is a function of p and of the steps so far, so rounds keep no state for
documents: documents of equal p are one cell, and each round is one aggregation over the cells, of which the driver gets the residual and G.
Mix.report() says how far the targets were met; where they weren't, a warning does.

Targets are the weights times a budget; if none is given, it is what gives the domain that is scarcest against its
weight all its tokens, and a little more, so that documents of that domain stay. Copies of a document: the whole part of its rate, and
one more with the probability of the rest, decided by a hash.

Posteriors are made row by row, in one pass over the texts and without a shuffle: the words of the classifier travel in the plan (WORDS at
most). So copies of a text, however many, meet nowhere.

Null texts and texts without tokens have n 0, the prior as posterior and count for no total; their rates follow the same rule.
Null or unknown labels are not learned from; without any labels every document is clean. Repeated rows get
equal rates. All columns stay; an empty table stays empty. Ties between words go to the word first in order.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, table, without

DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.92, "low": 0.06, "toxic": 0.02}
#: Bound of the sample the classifier is fitted on.
PER_DOMAIN = 1500
#: Words of the classifier.
WORDS = 2000
#: A word tells something only if so many documents of the sample have it.
SUPPORT = 8
SURE = 20.0
#: Intervals of the log odds of a domain against the first, in which texts count as of equal evidence.
EDGES = (-8.0, -2.0, 0.5, 2.0, 8.0)
CELLS = (len(EDGES) + 1) ** (len(DOMAINS) - 1)
ROUNDS = 60
TOLERANCE = 1e-9
#: Share of all tokens by which targets may be missed without a warning.
MISSED = 1e-4
#: Decimals of posteriors.
DIGITS = 4
SPARE = 1.05
SEPARATORS = r"[\s.,;:?\"'()\[\]]+"


def words(text: Column) -> Column:
    """The tokens: what stands between white space and punctuation (marks that shout stay with their word)."""
    return F.array_remove(F.split(text, SEPARATORS), "")


def featured(df: DataFrame, text: str, n: str = "n", features: str = "features") -> DataFrame:
    """df with the columns n (tokens) and features: the different words of a text, and signs for texts that repeat few words or are mostly cells of tables.

    Words and different words are projections of their own, so that each text is split once.
    """
    bars, every, own = fresh(df, "bars", "words", "own")
    body = F.col(f"`{text}`")
    split = df.withColumn(bars, F.char_length(body) - F.char_length(F.replace(body, F.lit("|")))).withColumn(every, words(body))
    split = split.withColumn(own, F.array_distinct(every)).withColumn(n, F.size(every).cast("long")).drop(every)
    repeats = F.when(F.size(own) < 0.3 * F.col(n), F.lit("#repeats"))
    cells = F.when(F.col(bars) > 0.2 * F.col(n), F.lit("#bars"))
    return split.withColumn(features, F.array_compact(F.concat(own, F.array(repeats, cells)))).drop(own, bars)


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 1, "clean").when(quality == 0, "low")


@dataclass(frozen=True)
class Classifier:
    """What is known of the domains: what telling words add for each, and the posteriors of each cell of evidence."""

    words: list[tuple[str, list[float]]]
    posteriors: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, id: str, text: str, scratch: Scratch) -> Classifier:
    """Words of the sample's texts that tell its domains apart, then the shares of domains among texts of equal evidence (absent words say nothing by themselves: texts are in many languages).

    A domain's words share its probability (each by the number of its texts that hold it), so that domains with longer texts don't gain by every common
    word; and domains that don't differ significantly by a word share its odds, as chance differences of many words would add up.
    """
    named = labels.select(F.col("doc_id").alias("id"), domain(F.col("quality"), F.col("toxic")).alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL")
    counts = {r["domain"]: r["count"] for r in named.groupBy("domain").count().collect()}
    if not counts:
        return Classifier([], np.array([[1.0] + [0.0] * (len(DOMAINS) - 1)] * CELLS))
    # At most PER_DOMAIN rows of each domain: a broadcast of bounded size.
    order = F.xxhash64("id")
    parts = [named.where(F.col("domain") == d).dropDuplicates(["id"]).orderBy(order, "id").limit(PER_DOMAIN) for d in DOMAINS if d in counts]
    sample = parts[0]
    for p in parts[1:]:
        sample = sample.union(p)
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL").join(F.broadcast(sample), "id")
    # Written first: else what explode() says of its input is filtered below the join, and every text of the corpus is split for it.
    rows, _ = scratch.write(rows.select("domain", "text").distinct())
    seen = featured(rows, "text").select("domain", F.explode("features").alias("word"))
    seen, _ = scratch.write(seen.groupBy("word").pivot("domain", list(DOMAINS)).count().na.fill(0))
    every = seen.agg(F.count("*").alias("words"), *[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DOMAINS]).first()
    total = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    size = [total.get(d, 0) for d in DOMAINS]
    share = [(F.col(d) + 0.5) / (n + 1.0) for d, n in zip(DOMAINS, size, strict=True)]
    # How much a word tells: its information about the domain, each domain that was seen counting the same.
    mean = sum(s for s, n in zip(share, size, strict=True) if n) / max(1, sum(n > 0 for n in size))
    parts = [s * F.log(s / mean) + (1 - s) * F.log((1 - s) / (1 - mean)) for s in share]
    told = sum((p for p, n in zip(parts, size, strict=True) if n), F.lit(0.0))
    sure = 2 * sum((p * n for p, n in zip(parts, size, strict=True)), F.lit(0.0)) >= SURE
    enough = sum(map(F.col, DOMAINS), F.lit(0)) >= SUPPORT
    pairs = list(combinations(range(len(DOMAINS)), 2))
    differ = [2 * tested(F.col(DOMAINS[i]), every[DOMAINS[i]], F.col(DOMAINS[j]), every[DOMAINS[j]]) >= SURE for i, j in pairs]
    best = seen.where(enough & sure & reduce(or_, differ)).select("word", *DOMAINS, F.array(*differ).alias("differ"), told.alias("told")).orderBy(F.round("told", 9).desc(), "word").limit(WORDS).collect()
    words = []
    for r in best:
        of = list(range(len(DOMAINS)))
        for (i, j), apart in zip(pairs, r["differ"], strict=True):
            if not apart:
                of = [min(of[i], of[j]) if k in (of[i], of[j]) else k for k in of]
        pooled = [sum(r[d] for d, k in zip(DOMAINS, of, strict=True) if k == own) for own in of]
        mass = [sum(every[d] for d, k in zip(DOMAINS, of, strict=True) if k == own) for own in of]
        odds = np.log([(c + 0.5) / (m + 0.5 * every["words"]) for c, m in zip(pooled, mass, strict=True)])
        words.append((r["word"], (odds - odds[0]).tolist()))
    # The sample's texts in cells of equal evidence: what share of each domain has it, times the domains' shares of the labels.
    found = evidence(rows, words, "text", "cell").groupBy("domain", "cell").count().collect()
    table = np.zeros((CELLS, len(DOMAINS)))
    for r in found:
        table[r["cell"], DOMAINS.index(r["domain"])] += r["count"]
    # Half a text more in each domain, spread as the domains' texts are on average, so that no cell is certain; unseen cells say nothing.
    average = (table / np.maximum(1, table.sum(axis=0))).mean(axis=1, keepdims=True)
    table += 0.5 * average + 1e-3
    prior = np.array([counts.get(d, 0) + 0.5 if counts.get(d) else 0.0 for d in DOMAINS])
    joint = table / table.sum(axis=0) * prior
    shares = np.round(joint / joint.sum(axis=1, keepdims=True), DIGITS)
    # Rounded shares of the others leave the rest to the first domain, so that the sum stays 1.
    shares[:, 0] = np.round(1 - shares[:, 1:].sum(axis=1), DIGITS)
    return Classifier(words, shares)


def tested(a: Column, n: int, b: Column, m: int) -> Column:
    """The likelihood ratio of a of n and b of m having different shares rather than one."""
    if not n or not m:
        return F.lit(0.0)
    both = (a + b) / float(n + m)
    part = lambda c, k: F.when(c > 0, c * F.log(c / float(k) / both)).otherwise(0.0) + F.when(c < k, (k - c) * F.log((1 - c / float(k)) / (1 - both))).otherwise(0.0)
    return part(a, n) + part(b, m)


def telling_words(weights: list[tuple[str, list[float]]]) -> tuple[Column, int]:
    """A literal hash table of the words: arrays of (word, adds), and their number."""
    size = max(1, len(weights))
    slots: list[list[dict]] = [[] for _ in range(size)]
    for word, adds in weights:
        # As xxhash64() has it: seed 42, signed.
        h = xxhash.xxh64_intdigest(word.encode(), 42)
        slots[(h - (h >> 63 << 64)) % size].append({"word": word, "adds": adds})
    return F.from_json(F.lit(json.dumps(slots)), "array<array<struct<word:string,adds:array<double>>>>"), size


def evidence(df: DataFrame, weights: list[tuple[str, list[float]]], text: str, cell: str, n: str | None = None) -> DataFrame:
    """df with the column cell: in which of the intervals of EDGES the evidence for each other domain against the first is. Nothing is shuffled."""
    size_of, features, odds = fresh(df, "size", "features", "odds")
    own = featured(df, text, n or size_of, features)
    slots, size = telling_words(weights)
    vocabulary = F.split(F.lit(" ".join(w for w, _ in weights)), " ")
    others = DOMAINS[1:]
    start = F.struct(*[F.lit(0.0).alias(d) for d in others])
    plus = lambda acc, x: F.struct(*[(acc[d] + x["adds"][k + 1]).alias(d) for k, d in enumerate(others)])
    add = lambda acc, w: F.aggregate(F.filter(F.get(slots, F.pmod(F.xxhash64(w), F.lit(size)).cast("int")), lambda x: x["word"] == w), acc, plus)
    own = own.withColumn(odds, F.aggregate(F.array_intersect(features, vocabulary), start, add)).drop(features)
    place = F.lit(0)
    for d in others:
        place = place * (len(EDGES) + 1) + sum((F.when(F.round(F.col(f"{odds}.{d}"), 9) > e, 1).otherwise(0) for e in EDGES), F.lit(0))
    return own.withColumn(cell, place).drop(odds, *([] if n else [size_of]))


def scored(docs: DataFrame, known: Classifier, text: str) -> DataFrame:
    """docs with n_tokens and p_... (columns of these names are replaced)."""
    added = ["n_tokens", *(f"p_{d}" for d in DOMAINS)]
    kept = without(docs, *added)
    body, cell = fresh(kept, "body", "cell")
    own = evidence(kept.withColumn(body, F.coalesce(F.col(f"`{text}`"), F.lit(""))), known.words, body, cell, "n_tokens")
    literal = lambda values: F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
    shares = [F.get(literal(known.posteriors[:, k].tolist()), F.col(cell)).alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return own.select(*[F.col(f"`{c}`") for c in kept.columns], "n_tokens", *shares)


def rate(steps: list[np.ndarray]) -> Column:
    """The rate after the steps."""
    r = F.lit(1.0)
    for y in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col(f"p_{d}") * float(v) for d, v in zip(DOMAINS, y, strict=True)), F.lit(0.0)))
    return r


def state(cells: DataFrame, r: Column) -> tuple[np.ndarray, np.ndarray]:
    """The expected totals at rates r, and the Gram matrix of what has a rate."""
    pairs = [(i, j) for i in range(len(DOMAINS)) for j in range(i, len(DOMAINS))]
    some = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
    sums = [some(F.col("n") * F.col(f"p_{d}") * F.col("rate")) for d in DOMAINS]
    sums += [some(F.when(F.col("rate") > 0, F.col("n") * F.col(f"p_{DOMAINS[i]}") * F.col(f"p_{DOMAINS[j]}"))) for i, j in pairs]
    row = cells.withColumn("rate", r).agg(*[x.alias(f"s{k}") for k, x in enumerate(sums)]).first()
    gram = np.zeros((len(DOMAINS),) * 2)
    for (i, j), v in zip(pairs, row[len(DOMAINS) :], strict=True):
        gram[i, j] = gram[j, i] = v
    return np.array(row[: len(DOMAINS)], float), gram


def solve(cells: DataFrame, weights: dict[str, float], budget: float | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The steps of the rounds, the targets, and the totals that the rates give."""
    now, gram = state(cells, F.lit(1.0))
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in DOMAINS])
    share = share / share.sum() if share.sum() else np.full(len(DOMAINS), 1 / len(DOMAINS))
    if budget is None:
        scarce = [t / s for t, s in zip(now, share, strict=True) if s > 0 and t > 0]
        # The domain with the largest weight keeps its tokens; a scarcer one is repeated.
        budget = SPARE * float(now[share.argmax()] / share.max()) if now[share.argmax()] > 0 else (min(scarce) if scarce else 0.0)
    target = share * budget
    if not gram.any():
        return [], target, now
    inverse = lambda g: np.linalg.pinv(g + 1e-9 * gram.max() * np.eye(len(DOMAINS)))
    whole = inverse(gram)
    error = lambda x: float((x - target) @ whole @ (x - target))
    steps: list[np.ndarray] = []
    live = gram
    for _ in range(ROUNDS):
        if np.abs(now - target).max() <= TOLERANCE * max(1.0, budget):
            break
        # The metric of what has a rate takes longer steps; where one doesn't bring the totals closer, that of all documents always does.
        for metric in (inverse(live), whole):
            step = metric @ (now - target)
            after, left = state(cells, rate([*steps, step]))
            if error(after) < error(now) * (0.9 if metric is not whole else 1.0):
                break
        else:
            break
        steps.append(step)
        now, live = after, left
    return steps, target, now


@dataclass(frozen=True)
class Mix:
    """Documents with posteriors (written once), and the rates that were found."""

    scored: DataFrame
    dice: str
    steps: list[np.ndarray]
    target: np.ndarray
    expected: np.ndarray

    def documents(self) -> DataFrame:
        """docs with n_tokens (long), p_... (double, one for each domain), rate (double) and copies (long)."""
        r = self.scored.withColumn("rate", rate(self.steps))
        return r.withColumn("copies", F.floor(F.col("rate") + F.col(self.dice)).cast("long")).drop(self.dice)

    def report(self) -> DataFrame:
        """(domain, target, expected): tokens of each domain as they should be and as the rates give them."""
        rows = [(d, float(t), float(e)) for d, t, e in zip(DOMAINS, self.target, self.expected, strict=True)]
        return self.scored.sparkSession.createDataFrame(rows, "domain string, target double, expected double")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, budget: float | None = None, id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> Mix:
    """Rates for docs; of their columns those in `keep` stay (all if None)."""
    scratch = Scratch(docs.sparkSession)
    known = fit(docs, labels, id, text, scratch)
    added = ["n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies"]
    own = without(docs, *added)
    (dice,) = fresh(own, "dice")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = scored(own.withColumn(dice, F.pmod(F.xxhash64(F.col(f"`{id}`"), body), F.lit(1 << 30)) / float(1 << 30)), known, text)
    stay = [c for c in own.columns if keep is None or c in keep or c == dice or c in added]
    rows, _ = scratch.write(own.select(*[F.col(f"`{c}`") for c in stay]))
    cells, _ = scratch.write(rows.where("n_tokens > 0").groupBy(*(f"p_{d}" for d in DOMAINS)).agg(F.sum("n_tokens").alias("n")))
    steps, target, expected = solve(cells, weights, budget)
    off = float(np.abs(expected - target).max())
    if off > MISSED * max(1.0, target.sum()):
        warnings.warn(f"the mix misses its targets by {off:.0f} of {target.sum():.0f} tokens: wanted {dict(zip(DOMAINS, target.round(), strict=True))}, expected {dict(zip(DOMAINS, expected.round(), strict=True))}", stacklevel=2)
    return Mix(rows, dice, steps, target, expected)


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, budget: float | None = None, id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    return mix(docs, labels, weights, budget, id, text, keep).documents()


def take_copies(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with each row as often as its copies, all columns as they are."""
    (row,) = fresh(docs, "row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col("doc_id"), F.col("text"))
    chosen = mixed(packed, labels, keep=[row]).where("copies > 0").select(row, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return chosen.select(f"{row}.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixed(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
