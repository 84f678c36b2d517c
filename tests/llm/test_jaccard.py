"""Similarity joins of shingle sets against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from conftest import DATA
from popmeasure.llm import common, jaccard
from popmeasure.llm.queries import oracle_sql, queries
from test_queries import duck, rows  # noqa: F401  (duck is a fixture)


def test_same_as_sql(spark, duck):  # noqa: F811
    df = queries()["op11_jaccard"](spark, DATA)
    got = duck.sql(oracle_sql()["op11_jaccard"])
    assert sorted(df.columns) == sorted(got.columns)
    assert rows(df.columns, df.collect()) == rows(got.columns, got.fetchall())


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, size, percent):
    """docs: doc_id, text. All pairs, and the least id of each component."""
    sets = [shingles(t, size) for _, t in docs]
    of = list(range(len(docs)))

    def find(k):
        while of[k] != k:
            k = of[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                of[find(i)] = find(j)
    ids = {}
    for k, (d, _) in enumerate(docs):
        ids.setdefault(find(k), []).append(d)
    least = {r: min((d for d in own if d is not None), default=None) for r, own in ids.items()}
    return sorted(((d, len(sets[k]), least[find(k)] if sets[k] else d) for k, (d, _) in enumerate(docs)), key=str)


def texts(seed, families=12, each=14):
    """Families of near copies: some chained (each made from the one before), some around one text; similarities from about 0.8 to 1."""
    rng, out = random.Random(seed), []
    words = [f"w{k}" for k in range(400)]
    common = " ".join(rng.choices(words, k=30))
    for f in range(families):
        base = rng.choices(words, k=rng.choice([8, 30, 60, 200]))
        now = base
        for _ in range(each):
            new = list(now if f % 2 else base)
            for _ in range(rng.choice([0, 0, 1, 1, 1, 2, 3])):
                at = rng.randrange(len(new))
                new[at : at + rng.choice([0, 1])] = rng.choices(words, k=rng.choice([0, 1, 2]))
            now = new or ["w0"]
            out.append(" ".join(now).title() if rng.random() < 0.2 else " ".join(now))
    out += [common + " " + " ".join(rng.choices(words, k=9)) for _ in range(40)]
    return out


@pytest.mark.parametrize(("size", "percent", "turns"), [(3, 90, 3), (1, 60, 1)])
def test_groups_by_brute_force(spark, monkeypatch, size, percent, turns):
    monkeypatch.setattr(jaccard, "TURNS", turns)
    own = texts(size * percent)
    docs = [(3 * k % 1009, t) for k, t in enumerate(own)] + [(5000, None), (5001, ""), (5002, " \t\n"), (None, own[3]), (5003, own[3].upper()), (5003, own[3]), (5003, own[60]), (None, "one of its kind"), (5004, "a"), (5005, "A"), (5006, "a b"), (5007, "É a b"), (5008, "é a b")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, size string, n int").repartition(5)
    got = sorted((tuple(r) for r in jaccard.similar_sets(df, size, percent).collect()), key=str)
    want = brute(docs, size, percent)
    assert got == want
    assert len({r[2] for r in want}) < len(want) - 20


def test_a_group_of_many_near_copies(spark):
    """One text, each copy with a word or two of its own: pairs among them are partly below the bound."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(75)]
    docs = []
    for k in range(400):
        new = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            new[rng.randrange(75)] = f"x{rng.randrange(30)}"
        docs.append((k, " ".join(new)))
    got = sorted((tuple(r) for r in jaccard.similar_sets(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    assert got == brute(docs, 3, 90)


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard.similar_sets(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in jaccard.similar_sets(spark.createDataFrame([(7, "a b c d")] * 3, schema)).collect()] == [(7, 2, 7)] * 3


def test_entries_look_into_fewer_blocks_the_later_their_place():
    """The sizes that an entry can link with, by trying out all; and the blocks that they lie in."""
    for percent in (50, 80, 90):
        cuts = jaccard.edges(percent)
        for s in (1, 2, 9, 10, 11, 57, 200):
            ats = np.arange(0, s - -(-percent * s // 100) + 1)
            low, high = jaccard.reach(np.full(len(ats), s), ats, percent)
            batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([s], pa.int32()), pa.array([list(range(len(ats)))], pa.list_(pa.int64()))], names=["n", "size", "prefix"])
            k, row, at, own, look = jaccard.block_entries(batch, percent)
            for a, lo, hi in zip(ats.tolist(), low.tolist(), high.tolist(), strict=True):
                fits = [t for t in range(1, 3 * s + 3) if 100 * min(s, t) >= percent * max(s, t) and 100 * min(s - a, t) >= percent * (s + t - min(s - a, t))]
                assert all(lo <= t <= hi for t in fits) and (not fits or (lo, hi) == (min(fits), max(fits)))
                blocks = {int(np.searchsorted(cuts, t, "right")) for t in fits}
                assert look[at == a].sum() == (max(blocks) - min(blocks) + 1 if blocks else 0) and own[at == a].sum() == bool(fits)


def test_bounds_hold_what_sets_share(spark):
    rng = random.Random(9)
    sets = {n: sorted(rng.sample(range(40), rng.randint(5, 30))) for n in range(30)}
    share = lambda a, b: len(set(sets[a]) & set(sets[b]))
    led = [(n, 0, len(sets[n]) - share(n, 0), len(sets[0]) - share(n, 0)) for n in range(1, 15)]
    pairs = [(a, b, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b]
    made = lambda own, schema: spark.createDataFrame(own, schema)
    share_all = lambda own: common.written(own.join(made([(a, b, share(a, b)) for a in sets for b in sets], "a long, b long, o int"), ["a", "b"]), "shared")
    got = jaccard.bounded(made(pairs, "a long, b long, size_a int, size_b int"), made(led, "n long, leader long, more int, fewer int"), share_all).collect()
    assert len(got) == len(pairs) and all(r["least"] <= share(r["a"], r["b"]) <= r["most"] for r in got)
    assert all(r["least"] == r["most"] for r in got if r["a"] >= 15)
