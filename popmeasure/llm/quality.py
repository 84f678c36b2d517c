"""Quality rules whose cutoffs carry a guarantee: few good documents are rejected in each stratum.

Base rules are fixed. Beyond them, each rule compares one measure of the text with a cutoff, chosen per
stratum (language) on labelled documents: going from the most lenient cutoff to stricter ones, a cutoff
stands while the exact binomial (Clopper-Pearson) upper bound of its false rejections, at error level
delta / (strata * rules), is at most risk / rules. That is fixed-sequence testing within a rule and
Bonferroni's correction over rules and strata: with probability 1 - delta, no stratum loses more than
`risk` of its good documents to all rules together. A rule that can't be certified rejects nothing.

Labels are joined by id to measures, not texts. What reaches the driver is one row of counts a stratum.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels, ready, written

RISK, DELTA = 0.05, 0.05
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Measures that rules compare, each with its cutoffs from lenient to strict. A text is rejected above the cutoff.
CUTOFFS = {
    "symbol_share": [4.0, 2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05],
    "bang_share": [4.0, 2.0, 1.0, 0.7, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05],
    "dup_line_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "repeat_share": [0.19, 0.17, 0.15, 0.12, 0.1, 0.08, 0.06],
    "upper_share": [0.95, 0.9, 0.8, 0.6, 0.5, 0.4, 0.3],
    "word_length": [40.0, 30.0, 20.0, 16.0, 13.0, 11.0],
}
SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper", "n_letters"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    rank, known = code, 1
    while known < window:  # ranks of pairs, of fours and so on: exact, no hash
        step = min(known, window - known)
        m = len(rank) - step
        rank = np.unique(rank[:m] * np.int64(len(words) + 1) + rank[step:], return_inverse=True)[1]
        known += step
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS. bytes.split() cuts at the ASCII white space that words exclude."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    squeezed = b"".join(words)
    letters = np.frombuffer(squeezed, np.uint8)
    chars = int(((letters & 0xC0) != 0x80).sum())
    upper = int(((letters >= 65) & (letters <= 90)).sum())
    lower = int(((letters >= 97) & (letters <= 122)).sum())
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), raw.count(b"!"), upper, upper + lower


def measured(docs: DataFrame) -> DataFrame:
    """Row by row: doc_id, stratum (lang, 'unknown' if null), the counts, base_failed and the measures that rules compare."""

    def run(batches):
        for batch in batches:
            values = np.array([measure(t.as_py()) for t in batch.column(2)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v) for v in values.T)], names=["doc_id", "stratum", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("unknown")).alias("stratum"), "text")
    out = rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))
    words, share = F.greatest("n_words", F.lit(1)), lambda c, of: F.col(c) / F.greatest(F.col(of), F.lit(1))
    return out.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
            "symbol_share": F.col("n_symbols") / words,
            "bang_share": F.col("n_bangs") / words,
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": F.col("n_repeat_words") / words,
            "upper_share": share("n_upper", "n_letters"),
            "word_length": F.col("word_chars") / words,
        }
    )


def log_tail(k: int, n: int, p: float) -> float:
    """Log of P(X <= k) for X ~ Binomial(n, p)."""
    if p <= 0 or k >= n:
        return 0.0
    if p >= 1:
        return -math.inf
    x = np.arange(1, k + 1)
    terms = np.r_[0.0, np.cumsum(np.log(n - x + 1) - np.log(x) + math.log(p) - math.log1p(-p))] + n * math.log1p(-p)
    top = terms.max()
    return min(0.0, float(top + np.log(np.exp(terms - top).sum())))


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound, at error `level`, of a rate with k hits in n."""
    if n == 0 or k >= n:
        return 1.0
    low, high, goal = k / n, 1.0, math.log(level)
    for _ in range(60):
        mid = (low + high) / 2
        if log_tail(k, n, mid) > goal:
            low = mid
        else:
            high = mid
    return high


def certified(n: int, rejected: list[int], risk: float, level: float) -> int:
    """Number of cutoffs, from the lenient end, whose false rejections are certified: the first failure ends the sequence."""
    for k, hits in enumerate(rejected):
        if hits > risk * n or upper_bound(hits, n, level) > risk:
            return k
    return len(rejected)


def choose_cutoffs(rows: DataFrame, truth: DataFrame, risk: float = RISK, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule. rows: measured(); truth: doc_id, quality (1 good, 0 not; other values and nulls are not used).

    A document with several labels counts as good only if all say so; repeated rows count once.
    """
    good = truth.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("good")).where("good = 1")
    held = rows.where("not base_failed").join(good, rows["doc_id"] == good["__id"], "left_semi").dropDuplicates(["doc_id"])
    counts = [F.count_if(F.col(m) > c).alias(f"{m}_{k}") for m, cuts in CUTOFFS.items() for k, c in enumerate(cuts)]
    by_stratum = {r["stratum"]: r for r in held.groupBy("stratum").agg(F.count("*").alias("n"), *counts).collect()}
    level = delta / max(1, len(by_stratum) * len(CUTOFFS))
    out: dict[str, dict[str, float]] = {}
    for stratum, r in by_stratum.items():
        for m, cuts in CUTOFFS.items():
            if k := certified(r["n"], [r[f"{m}_{i}"] for i in range(len(cuts))], risk / len(CUTOFFS), level):
                out.setdefault(stratum, {})[m] = cuts[k - 1]
    return out


def judged(rows: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """rows with cutoffs applied: the column kept. Strata without cutoffs keep what passes the base rules."""
    chosen = [(s, *(c.get(m) for m in CUTOFFS)) for s, c in cutoffs.items()]
    schema = "__stratum string, " + ", ".join(f"__{m} double" for m in CUTOFFS)
    table = rows.sparkSession.createDataFrame(chosen, schema)
    above = [F.coalesce(F.col(m) > F.col(f"__{m}"), F.lit(False)) for m in CUTOFFS]
    verdict = ~F.col("base_failed")
    for a in above:
        verdict = verdict & ~a
    joined = rows.join(F.broadcast(table), F.col("stratum") == F.col("__stratum"), "left")
    return joined.withColumn("kept", verdict).drop(*table.columns)


def quality_verdicts(docs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, stratum, counts, measures, base_failed, kept.

    Null and empty texts have no words and fail. A null language is the stratum 'unknown'. Null ids match
    no label. Empty docs give an empty result; without labels, what passes the base rules is kept. Other
    columns are not read.
    """
    rows = written(measured(docs), "measures")
    return judged(rows, choose_cutoffs(rows, truth))


def keeps(values: tuple[int, ...], cutoffs: dict[str, float]) -> bool:
    """The verdict on one text, from its counts and its stratum's cutoffs."""
    c = dict(zip(COUNTS, values, strict=True))
    words = max(1, c["n_words"])
    if c["n_words"] < MIN_WORDS or 100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"]:
        return False
    measures = {
        "symbol_share": c["n_symbols"] / words,
        "bang_share": c["n_bangs"] / words,
        "dup_line_share": c["n_dup_lines"] / max(1, c["n_lines"]),
        "repeat_share": c["n_repeat_words"] / words,
        "upper_share": c["n_upper"] / max(1, c["n_letters"]),
        "word_length": c["word_chars"] / words,
    }
    return all(measures[m] <= cut for m, cut in cutoffs.items())


def passing(docs: DataFrame, truth: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, whose text is kept. Repeated ids are judged row by row. No text is shuffled."""
    ready(docs.sparkSession)
    cutoffs = choose_cutoffs(written(measured(docs), "measures"), truth)
    names = [c.lower() for c in docs.columns]
    text, lang = names.index("text"), names.index("lang")

    def run(batches):
        for batch in batches:
            stay = [keeps(measure(t), cutoffs.get("unknown" if s is None else s, {})) for t, s in zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist(), strict=True)]
            yield batch.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts, base_failed and kept of every document; a null text has no words, so it fails the base rules."""
    rows = quality_verdicts(documents(spark, sf_dir), labels(spark, sf_dir))
    return rows.select("doc_id", *COUNTS[:5], "base_failed", "kept", "stratum", *CUTOFFS)
