"""Mixing to target weights with soft membership.

A classifier is fitted on a bounded sample of labelled documents and gives every document a posterior over
domains. Document rates are then fitted so that the expected tokens of each domain meet targets: rates are
nonnegative and as near to 1 as the targets allow, and tokens in all stay as many (see fit()). A rate depends on a
document's posterior alone, so documents with equal posteriors are added up once; posteriors are rounded, so these are
a few thousand sums however many documents there are, and the fit runs over them on the driver. No rate table is ever
rewritten: the rate is an expression of the posterior and of one number a domain.

Domains are toxic, low (labelled quality 0) and high. The classifier is naive Bayes over binned
measures of the text, among them how many words it has that tell a domain: half of the sample finds these
words, the other half counts the bins. All of it is DataFrame operations; no Python runs on
executors. Only counts of the sample (domains x (WORDS + bins)) and tokens by rounded posterior reach the driver.
"""

from __future__ import annotations

import logging
import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels, let, written

DOMAINS = ["high", "low", "toxic"]
#: Share of expected tokens that each domain should have, of as many tokens as there are.
TARGETS = {"high": 0.9, "low": 0.07, "toxic": 0.03}
#: Labelled documents that the classifier is fitted on at most (in expectation), words it knows, least documents of a word,
#: and how many times as frequent as in all a word must be in some domain.
SAMPLE, WORDS, LEAST, LIFT = 20_000, 256, 3, 4.0
#: Newton steps at most, when a fit is done and when it has converged after these steps (of all tokens), the miss (of its goal) that is told of, and the weight of nearness to 1 beside a miss.
STEPS, DONE, ENOUGH, CLOSE, RIDGE = 500, 1e-8, 1e-6, 1e-4, 1e-7
SEED = "mixing"
SPACE, MARKS = r"[\x20\x09-\x0D]+", "#*$%&|<>!"
#: Cuts of each measure into bins.
CUTS = {"marks": [0.001, 0.005, 0.02, 0.06], "words": [5, 20, 100], "repeats": [0.2, 0.3, 0.5, 0.7]}
HITS = [1, 2, 4]


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts the value reaches; the value is computed once."""
    return let(value, lambda v: sum(((v >= c).cast("int") for c in cuts), F.lit(0)))


def features(docs: DataFrame) -> DataFrame:
    """docs with __tokens (words), __words (distinct words in lower case) and __bins. A null text has none. The text is split once."""
    text = F.coalesce("text", F.lit(""))
    split = docs.withColumn("__split", F.split(F.trim(F.lower(text)), SPACE))
    words = split.withColumn("__words", F.array_distinct("__split")).withColumn("__tokens", F.when(F.element_at("__words", 1) == "", F.greatest(F.size("__split") - 1, F.lit(0))).otherwise(F.size("__split")).cast("long"))
    bare = F.call_function("translate", text, F.lit(MARKS), F.lit(""))
    values = {
        "marks": (F.octet_length(text) - F.octet_length(bare)) / F.greatest(F.octet_length(text), F.lit(1)),
        "words": F.col("__tokens"),
        "repeats": F.size("__words") / F.greatest(F.size("__split"), F.lit(1)),
    }
    return words.withColumn("__bins", F.array(*(_bin(v, CUTS[m]) for m, v in values.items()))).drop("__split")


def labelled(docs: DataFrame, truth: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """A sample, by hash of the id, of documents with their domain. Several labels of one document: the worst counts."""
    kinds = truth.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    every = max(1, math.ceil(kinds.count() / limit))
    domain = F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "low").otherwise("high")
    chosen = kinds.where(F.pmod(F.xxhash64("__id"), F.lit(every)) == 0).select("__id", domain.alias("domain"))
    return docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("__id")).select("text", "domain", F.pmod(F.xxhash64(F.lit("half"), "__id"), F.lit(2)).alias("__half"))


class Classifier:
    """Words that tell each domain, and log probabilities by domain: of the domains, and of each bin of each measure."""

    def __init__(self, words: list[list[str]], start: list[float], bins: list[list[list[float]]]):
        self.words, self.start, self.bins = words, start, bins


def with_hits(words: list[list[str]]) -> Column:
    """The bins of features() and, for each domain, of how many of its words the text has."""
    texts = lambda own: F.split(F.lit(" ".join(own)), " ") if own else F.array().cast("array<string>")
    found = F.array_intersect("__words", texts([w for own in words for w in own]))
    return F.concat("__bins", let(found, lambda f: F.array(*(_bin(F.size(F.array_intersect(f, texts(own))), HITS) for own in words))))


def telling_words(rows: DataFrame) -> list[list[str]]:
    """For each domain the words that are LIFT times as frequent in it as in all, first by how much they tell, then by name."""
    have = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = [have.get(d, 0) + 1 for d in DOMAINS]
    seen = rows.select("domain", F.explode("__words").alias("word")).where("word <> ''").groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS))
    share = [(F.col(d) + 0.5) / (n + 1) for d, n in zip(DOMAINS, total, strict=True)]
    mean = sum((s * (n / sum(total)) for s, n in zip(share, total, strict=True)), F.lit(0.0))
    tells = [F.struct((s * F.log(s / mean / LIFT)).alias("tell"), F.lit(k).alias("domain")) for k, s in enumerate(share)]
    often = seen.where(sum((F.col(d) for d in DOMAINS), F.lit(0)) >= LEAST)
    top = often.withColumn("best", F.greatest(*tells)).where("best.tell > 0").orderBy(F.desc("best.tell"), "word").limit(WORDS).collect()
    return [sorted(r["word"] for r in top if r["best"]["domain"] == k) for k in range(len(DOMAINS))]


def fit_classifier(sample: DataFrame) -> Classifier:
    """Naive Bayes from counts in the sample, with add-one smoothing."""
    rows = written(features(sample).select("domain", "__words", "__bins", "__half"), "labelled")
    words = telling_words(rows.where("__half = 0"))
    rest = rows.where("__half = 1").select("domain", with_hits(words).alias("__bins"))
    have = {r["domain"]: r["n"] for r in rest.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = [have.get(d, 0) + 1 for d in DOMAINS]
    counts = rest.select("domain", F.posexplode("__bins").alias("measure", "bin")).groupBy("domain", "measure", "bin").agg(F.count("*").alias("n")).collect()
    n = {(r["domain"], r["measure"], r["bin"]): r["n"] for r in counts}
    bins = [
        [[math.log((n.get((d, m, b), 0) + 1) / (t + len(cuts))) for d, t in zip(DOMAINS, total, strict=True)] for b in range(len(cuts) + 1)]
        for m, cuts in enumerate([*CUTS.values(), *[HITS] * len(DOMAINS)])
    ]
    return Classifier(words, [math.log(t / sum(total)) for t in total], bins)


def _vector(values: list[float]) -> Column:
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _plus(logs: Column, flat: Column, row: Column) -> Column:
    """logs plus a row (from 0) of a table that is held row after row in flat."""
    return F.transform(logs, lambda v, i: v + F.element_at(flat, (row * len(DOMAINS) + i + 1).cast("int")))


def posterior(model: Classifier) -> Column:
    """Array of the domains' probabilities, rounded to 1/100 so that near-equal documents fall together."""

    def logs(bins: Column) -> Column:
        out = _vector(model.start)
        for m, table in enumerate(model.bins):
            out = _plus(out, _vector([v for row in table for v in row]), F.element_at(bins, m + 1))
        return out

    def shares(x: Column) -> Column:
        exp = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        return let(exp, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(e, lambda v: F.round(v / s, 2))))

    ones = lambda p: let(F.aggregate(p, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(p, lambda v: v / s))
    return let(let(let(with_hits(model.words), logs), shares), ones)


def _dot(p: Column, s: Column) -> Column:
    return F.aggregate(F.zip_with(p, s, lambda a, b: a * b), F.lit(0.0), lambda x, v: x + v)


def rate_of(p: Column, pull: list[float]) -> Column:
    """A rate of 1 less the pull along the posterior, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - _dot(p, _vector(pull)))


class Fit(NamedTuple):
    """What rates end at (one number a domain), and each domain's goal in tokens and the share of it that is missed."""

    pull: list[float]
    goal: dict[str, float]
    miss: dict[str, float]


def _solved(p: np.ndarray, w: np.ndarray, share: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The pull where weights w of posteriors p, times their rates, add up to share, or miss it least by scale."""
    pull, bend = np.zeros(p.shape[1]), RIDGE * (np.diag(scale) - np.outer(scale, scale) / scale.sum())

    def value(x):
        return 0.5 * float(w @ np.maximum(0.0, 1 - p @ x) ** 2) + float(share @ x) + 0.5 * float(x @ bend @ x)

    def slope(x):
        return share + bend @ x - p.T @ (w * np.maximum(0.0, 1 - p @ x))

    for _ in range(STEPS):
        wrong = slope(pull)
        if np.abs(wrong).max() < DONE:
            return pull
        free = w * (p @ pull < 1)
        move = -np.linalg.lstsq(p.T @ (free[:, None] * p) + bend, wrong, rcond=1e-15)[0]
        size, now, down = 1.0, value(pull), float(wrong @ move)
        while size > 1e-9 and value(pull + size * move) > now + 1e-4 * size * down + 1e-14 * (1 + abs(now)):
            size /= 2
        pull = pull + size * move
    if np.abs(slope(pull)).max() < ENOUGH:  # as near as the numbers' precision allows
        return pull
    raise RuntimeError(f"rates did not converge: {np.abs(slope(pull)).max()} of all tokens off after {STEPS} steps")


def fit(sums: DataFrame, targets: dict[str, float] = TARGETS) -> Fit:
    """Fits rates to the targets as they are given. sums: post, tokens.

    Minimised is the squared distance of the rates from 1 (by tokens) among the nonnegative rates that meet all
    goals; tokens in all stay as many. Goals that no rates meet are missed by the least squares (over each goal).
    It is solved over the dual, one number a domain, by Newton steps that are halved until they help. Raises
    RuntimeError where that doesn't converge; misses are returned and logged.
    """
    rows = sums.groupBy("post").agg(F.sum("tokens").alias("tokens")).where("tokens > 0").collect()
    p, w = np.array([r["post"] for r in rows]).reshape(-1, len(DOMAINS)), np.array([r["tokens"] for r in rows], float)
    total, share = float(w.sum()), np.array([targets[d] for d in DOMAINS], float)
    share = share / share.sum()
    if not total:
        return Fit([0.0] * len(DOMAINS), dict.fromkeys(DOMAINS, 0.0), dict.fromkeys(DOMAINS, 0.0))
    w, scale = w / total, np.maximum(share, 1e-3)
    pull = _solved(p, w, share, scale)
    off = p.T @ (w * np.maximum(0.0, 1 - p @ pull)) - share
    miss = {d: float(o / s) for d, o, s in zip(DOMAINS, off, scale, strict=True)}
    if max(map(abs, miss.values())) > CLOSE:
        logging.getLogger(__name__).warning("targets %s are missed by (share of each goal) %s", targets, miss)
    return Fit(pull.tolist(), {d: float(s * total) for d, s in zip(DOMAINS, share, strict=True)}, miss)


def fit_rates(sums: DataFrame, targets: dict[str, float] = TARGETS) -> tuple[list[float], dict[str, float]]:
    """What rates end at, one number a domain, and the relative miss of each domain that remains. sums: post, tokens."""
    found = fit(sums, targets)
    return found.pull, found.miss


def weighed(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with tokens and post (columns of these names are replaced)."""
    return features(docs).withColumns({"tokens": F.col("__tokens"), "post": posterior(model)}).drop("__tokens", "__words", "__bins")


def with_copies(rows: DataFrame, pull: list[float]) -> DataFrame:
    u = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(1 << 40)) / float(1 << 40)
    rated = rows.withColumn("rate", rate_of(F.col("post"), pull))
    return rated.withColumn("copies", (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def sums_by_posterior(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy("post").agg(F.sum("tokens").cast("double").alias("tokens")), "posteriors")


def rates(docs: DataFrame, truth: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """One row for each row of docs: doc_id, tokens, post (array, in the order of DOMAINS), rate, copies, and the fit's goal
    and miss of each domain (arrays, alike for all rows). Texts are read once.

    copies is the rate rounded down, and one more with the probability of what is left (by hash of the id, so
    equal ids fare alike). Null texts have no tokens. Without labels the posterior is that of the smoothed
    counts, alike for all. Repeated rows stay; an empty table stays empty; other columns are not read.
    """
    model = fit_classifier(labelled(docs, truth))
    rows = written(weighed(docs.select("doc_id", "text"), model).drop("text"), "weighed")
    found = fit(sums_by_posterior(rows), targets)
    return with_copies(rows, found.pull).withColumns({"goal": _vector(list(found.goal.values())), "miss": _vector(list(found.miss.values()))})


def repeated(docs: DataFrame, truth: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs, with their columns, as often as copies says; misses are logged by fit(). Rates are worked out anew beside each text, so no text is shuffled."""
    model = fit_classifier(labelled(docs, truth))
    pull = fit(sums_by_posterior(weighed(docs.select("doc_id", "text"), model)), targets).pull
    own = docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))
    rows = with_copies(weighed(own, model), pull)
    # A filter on copies would be pushed below and copy all that copies is made of into itself; so rows without copies go after the explode.
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies")))
    return rows.select("__row", F.explode_outer(times).alias("__copy")).where("__copy is not null").select("__row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens, the posterior of each domain, rate and copies of every document; goal and miss of each domain."""
    rows = rates(documents(spark, sf_dir), labels(spark, sf_dir))
    return rows.select("doc_id", "tokens", *(F.element_at("post", i + 1).alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", "copies", *(F.element_at(c, i + 1).alias(f"{c}_{d}") for c in ("goal", "miss") for i, d in enumerate(DOMAINS)))
