"""Language mixtures: expectation-maximisation over n-gram likelihoods, with a penalty for each language.

Training counts letter trigrams of labelled texts by language, in all labelled rows: tasks count into arrays
of a fixed size, and Spark adds the counts up. The model (languages x GRAMS smoothed probabilities) has a
bounded size and is broadcast.

A text's trigrams are taken as drawn from a mixture of languages. The set of languages grows from the best
single one: the language whose gradient of the log-likelihood is steepest is tried, the proportions are
fitted by expectation-maximisation, and it stays if the log-likelihood gains more than PENALTY * log(n) / 2
(the Bayesian information criterion, times a factor as neighbouring trigrams depend on each other).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, ready

#: Trigrams are hashed to this many values; added to each count; factor of the penalty; rounds of fitting.
GRAMS, SMOOTH, PENALTY, ROUNDS = 1 << 15, 0.1, 6.0, 25
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point of the basic plane: is it a letter."""
    return np.array([chr(k).isalpha() for k in range(1 << 16)])


#: Characters of a text that are handled at a time.
PIECE = 1 << 18


def _codes(text: str) -> np.ndarray:
    """The text's letters in lower case as code points; each run of other characters is one 0."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    low = code < 1 << 16
    alpha = np.zeros(len(code), bool)
    alpha[low] = letters()[code[low]]
    if not low.all():
        alpha[~low] = [chr(c).isalpha() for c in code[~low]]
    code = np.where(alpha, code, 0).astype(np.uint64)
    return code[np.r_[True, (code[1:] != 0) | (code[:-1] != 0)]] if len(code) else code


def gram_table(text: str | None) -> np.ndarray:
    """How often the text has each hashed trigram of its letters in lower case; runs of other characters are one gap, as are both ends. Zeros without a letter.

    Piece by piece, so that the memory doesn't depend on the text's length.
    """
    out, last, some, text = np.zeros(GRAMS, np.int64), np.zeros(1, np.uint64), False, text or ""
    for begin in range(0, len(text) + 1, PIECE):
        new = _codes(text[begin : begin + PIECE])
        some = some or bool(new.any())
        code = np.r_[last, new[1:] if last[-1] == 0 and len(new) and new[0] == 0 else new]
        if begin + PIECE > len(text) and code[-1] != 0:
            code = np.r_[code, np.uint64(0)]
        if len(code) > 2:
            mixed = (code[:-2] * np.uint64(0x9E3779B1) + code[1:-1] * np.uint64(0x85EBCA77C2B2AE63) + code[2:] * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
            out += np.bincount((mixed >> np.uint64(64 - 15)).astype(np.int64), minlength=GRAMS)
        last = code[-2:]
    return out if some else np.zeros(GRAMS, np.int64)


def gram_counts(rows: DataFrame) -> DataFrame:
    """rows: lang, text. Returns lang, gram, n over all rows; a task sends each pair once."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(GRAMS, np.int64))
                own += gram_table(text)
        for lang, own in counts.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(own[seen])], names=["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Names of languages in order, and p[gram, language]."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + SMOOTH
        self.p = (smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float64)
        self.log = np.log(self.p)


def train(rows: DataFrame) -> Model:
    """rows: lang, text; rows without either are not used. Ties and the order of rows change nothing: counts are sums."""
    ready(rows.sparkSession)
    found = gram_counts(rows.where("lang is not null and text is not null")).toPandas()
    names = sorted(found["lang"].unique())
    counts = np.zeros((GRAMS, len(names)))
    counts[found["gram"], np.searchsorted(names, found["lang"])] = found["n"]
    return Model(names, counts)


def fit(p: np.ndarray, weight: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the columns of p that expectation-maximisation reaches, and their log-likelihood; weight is how often each row was seen."""
    share, n = start, weight.sum()
    for _ in range(ROUNDS):
        mixed = p @ share
        new = share * (weight @ (p / mixed[:, None])) / n
        if np.abs(new - share).max() < 1e-4:
            share = new
            break
        share = new
    return share, float(weight @ np.log(p @ share))


def mixture(model: Model, table: np.ndarray) -> dict[int, float]:
    """Proportions of the languages that the penalised likelihood selects for a gram_table(); ties go to the first name.

    Distinct trigrams count with their numbers: at most GRAMS rows, however long the text.
    """
    grams = np.flatnonzero(table)
    if not len(grams) or not model.names:
        return {}
    weight = table[grams].astype(float)
    single = weight @ model.log[grams]
    chosen, share, best, n = [int(single.argmax())], np.ones(1), float(single.max()), weight.sum()
    gain, p = PENALTY * np.log(n) / 2, model.p[grams]
    while len(chosen) < len(model.names):
        slope = weight @ (p / (p[:, chosen] @ share)[:, None]) / n
        slope[chosen] = 0
        new = int(slope.argmax())
        if slope[new] <= 1:  # no proportion of any other language would raise the likelihood
            break
        tried, likely = fit(p[:, [*chosen, new]], weight, np.r_[share * 0.9, 0.1])
        if likely - best <= gain:
            break
        chosen, share, best = [*chosen, new], tried, likely
    return dict(zip(chosen, share.tolist(), strict=True))


LANGUAGES = "array<struct<lang:string,share:double>>"
_LANGUAGES = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (its proportion), mixture (languages by falling proportion) of each row of docs.

    Null texts and texts without a letter are `und` with score 0 and an empty mixture, as is any text if the
    model knows no language. Repeated rows stay, an empty table stays empty. Only doc_id and text are read.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in batches:
            found = []
            for t in batch.column(1):
                share = mixture(known, gram_table(t.as_py()))
                found.append([{"lang": known.names[k], "share": min(1.0, s)} for k, s in sorted(share.items(), key=lambda x: (-x[1], x[0]))])
            best = [f[0] if f else {"lang": UNKNOWN, "share": 0.0} for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b["lang"] for b in best], pa.string()), pa.array([b["share"] for b in best], pa.float64()), pa.array(found, _LANGUAGES)], names=["doc_id", "lang_pred", "score", "mixture"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, lang_pred string, score double, mixture {LANGUAGES}")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that training leaves out. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_languages of every document; the model is trained on those not held out."""
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out()))
    found = languages(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_languages"))
