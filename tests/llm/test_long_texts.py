"""Texts of a million characters and more, of the kinds that cost most; and the mixture of languages by brute force."""

import math
import random
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from popmeasure.llm import digest, language, novelty


@pytest.mark.parametrize("text", ["a😀" * 500_000 + "é", "é😀" * 100_000, "́a" * 100_000, "e" + "̣́" * 3_000, "̣" * 50_000])
def test_canonical_forms_of_long_texts(spark, text):
    got = spark.createDataFrame([(text,)], "text string").select(digest.canonical(F.col("text"))).first()[0]
    assert got == unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).lower())


@pytest.mark.parametrize("word", [*novelty.CONTEXT_WORDS, "token1"])
def test_long_texts_of_sensitive_words(word):
    for joint in (" ", "", "_", "="):
        text = (word + joint) * (1_000_000 // len(word + joint))
        begun = time.process_time()
        novelty.scan(text)
        assert time.process_time() - begun < 4


def test_tokens_longer_than_any_secret_are_data():
    rng = random.Random(1)
    key = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(novelty.MOST_LONG + 1))
    assert novelty.scan(f"bearer {key}") == []
    assert novelty.scan(f"bearer {key[1:]}") == [(7, 3, 7 + novelty.MOST_LONG)]


def plain_trigrams(text):
    """Trigrams of the letters, one by one."""
    gaps = "".join(c if c.isalpha() else "\0" for c in text.lower())
    line = "\0" + gaps + "\0"
    kept = [c for k, c in enumerate(line) if c != "\0" or k == 0 or line[k - 1] != "\0"]
    return ["".join(kept[k : k + 3]) for k in range(len(kept) - 2)] if any(c != "\0" for c in kept) else []


def test_trigrams_are_counted_piece_by_piece(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé 12.J😀𝒜") for _ in range(n)) for n in (0, 1, 2, 3, 50, 999)] + ["  a  ", "12 .", "ab"]
    whole = [language.gram_table(t) for t in texts]
    assert [int(w.sum()) for w in whole] == [len(plain_trigrams(t)) for t in texts]
    for piece in (1, 2, 3, 7):
        monkeypatch.setattr(language, "PIECE", piece)
        assert all(np.array_equal(language.gram_table(t), w) for t, w in zip(texts, whole, strict=True))


def test_mixtures_by_brute_force():
    """Expectation-maximisation over single trigrams with plain numbers, and the penalised choice among languages."""
    rng = np.random.default_rng(4)
    counts = rng.gamma(0.05, 1, (language.GRAMS, 4)) * 1000
    model = language.Model(["a", "b", "c", "d"], counts)
    drawn = np.concatenate([rng.choice(language.GRAMS, 300, p=model.p[:, 1]), rng.choice(language.GRAMS, 200, p=model.p[:, 3])])
    p = [[float(model.p[g, k]) for k in range(4)] for g in drawn]

    def likelihood(share):
        return sum(math.log(sum(row[k] * s for k, s in share.items())) for row in p)

    def fitted(share):
        for _ in range(language.ROUNDS):
            new = dict.fromkeys(share, 0.0)
            for row in p:
                total = sum(row[k] * s for k, s in share.items())
                for k, s in share.items():
                    new[k] += s * row[k] / total / len(p)
            done, share = max(abs(new[k] - share[k]) for k in share) < 1e-4, new
            if done:
                break
        return share

    best = max(range(4), key=lambda k: likelihood({k: 1.0}))
    share = {best: 1.0}
    while len(share) < 4:
        slope = {k: sum(row[k] / sum(row[j] * s for j, s in share.items()) for row in p) / len(p) for k in range(4) if k not in share}
        new = max(slope, key=slope.get)
        tried = fitted({k: 0.9 * s for k, s in share.items()} | {new: 0.1})
        if slope[new] <= 1 or likelihood(tried) - likelihood(share) <= language.PENALTY * math.log(len(p)) / 2:
            break
        share = tried
    got = language.mixture(model, np.bincount(drawn, minlength=language.GRAMS))
    assert got.keys() == share.keys() and len(share) == 2
    assert all(math.isclose(got[k], share[k], rel_tol=1e-9) for k in share)
