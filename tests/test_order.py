"""Running totals, quantiles, resamples and permutations against brute force, with blocks and rounds made small."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from popmeasure.operators import distances as G
from popmeasure.operators import order as O
from popmeasure.operators import resampling as R
from popmeasure.operators import statistics as T
from popmeasure.operators import summaries as S


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), k, rng.randrange(5)) for k in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, w int").repartition(7)
    got = {(r["g"], r["k"]): (r["before"], r["total"]) for r in O.running_totals(df, ["k"], F.col("w"), ["g"], parts=5).collect()}
    assert got == {(g, k): (sum(w for h, j, w in rows if h == g and j < k), sum(w for h, _, w in rows if h == g)) for g, k, _ in rows}
    alone = {r["k"]: r["before"] for r in O.running_totals(df.where("g = 'a'"), ["k"], F.lit(1), parts=3).collect()}
    assert alone == {k: n for n, k in enumerate(sorted(k for g, k, _ in rows if g == "a"))}
    assert O.running_totals(df.where("k < 0"), ["k"], F.lit(1)).count() == 0


def test_no_task_orders_all_pairs(spark):
    pairs = spark.range(200).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"), (F.col("id") % 50).cast("double").alias("d"))
    out = G.pair_standing(pairs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert windows and all("[__part" in line for line in windows)
    got = {r["a"]: (r["rank"], r["share"]) for r in out.collect()}
    assert got["0"] == (1, 4 / 200) and got["49"] == (197, 1.0) and got["103"] == (13, 16 / 200)


@pytest.mark.parametrize(("bins", "few"), [(4, 2), (256, 4096), (2, 0)])
def test_quantiles(spark, bins, few):
    rng = random.Random(2)
    values = {"even": [rng.random() for _ in range(300)], "steep": [math.exp(rng.uniform(-300, 300)) for _ in range(200)], "ties": [7.0] * 150 + [1.0, 9.0], "one": [3.0], "wide": [-1.7e308, 0.0, 1.7e308], None: [-1.0, 2.0]}
    rows = [(g, x) for g, xs in values.items() for x in xs] + [("even", None), ("even", float("nan")), ("even", float("inf")), ("none", None)]
    probs = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {r["g"]: (r["n"], r["q"]) for r in O.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(3), ["g"], "x", probs, bins, few).collect()}
    assert got.keys() == values.keys()
    for g, xs in values.items():
        assert got[g][0] == len(xs) and all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got[g][1], np.quantile(xs, probs) if g != "wide" else [-1.7e308, -1.7e308 + 0.05 * 1.7e308, 0.0, 0.8 * 1.7e308, 1.7e308], strict=True))


def test_summary_of_groups_without_values(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None), (None, 2.0)], "g string, value double")
    got = {r["g"]: tuple(r)[1:] for r in S.summary(rows, ["g"]).collect()}
    assert got["b"] == (None, None, None, 0) and got[None] == (2.0, 2.0, None, 1) and got["a"][:2] == (2.5, 2.5)


def drawn(n, reps, seed):
    """How often each of n places is drawn, resample by resample, one draw of bits at a time."""
    depth, out = (n - 1).bit_length(), []
    mixed = lambda x: int(R.mixed(np.array([x]))[0])
    for rep in range(1, reps + 1):
        counts, open_ = [0] * n, [(mixed(seed ^ rep), 0, 0, n)]
        while open_:
            key, level, index, m = open_.pop()
            node = (1 << level) | index
            h = mixed(mixed(key ^ (node & R.LOW)) ^ (node >> 32))
            if index << (depth - level) >= n:
                open_.append((mixed(h ^ 0x5851F42D), 0, 0, m))
            elif level == depth:
                counts[index] += m
            else:
                bits = "".join(f"{mixed((h + c * 0x9E3779B9) & R.LOW):032b}"[::-1] for c in range((m + 31) // 32))
                left = bits[:m].count("1")
                open_ += [(key, level + 1, 2 * index + k, c) for k, c in ((0, left), (1, m - left)) if c]
        assert sum(counts) == n
        out.append(counts)
    return out


@pytest.mark.parametrize("block", [2, 5, 16])
def test_bootstrap_deals_all_draws(spark, block):
    rng = random.Random(3)
    values = {"one": [5.0], "two": [1.0, 2.0], "some": [rng.gauss(0, 1) for _ in range(90)], "power": [rng.random() for _ in range(64)]}
    rows = [(g, k, x) for g, xs in values.items() for k, x in enumerate(xs)] + [("some", 99, None), ("some", 98, float("nan")), ("none", 1, None)]
    got = {r["g"]: tuple(r)[1:] for r in R.bootstrap_mean(spark.createDataFrame(rows, "g string, k int, x double").repartition(3), ["g"], "x", ["k"], 40, block=block).collect()}
    assert got.keys() == values.keys()
    for g, xs in values.items():
        import hashlib

        seed = int(hashlib.md5(f"boot|{g}".encode()).hexdigest()[:8], 16)
        means = [sum(c * x for c, x in zip(counts, xs, strict=True)) / len(xs) for counts in drawn(len(xs), 40, seed)]
        want = (len(xs), statistics.fmean(xs), *np.quantile(means, [0.025, 0.975]))
        assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(got[g], want, strict=True))


def test_bits_are_counted_in_pieces(monkeypatch):
    h, m = np.arange(9) * 12345, np.array([1, 31, 32, 33, 64, 65, 1000, 7, 96])
    whole = R._to_the_left(h, m)
    monkeypatch.setattr(R, "WORDS", 3)
    assert np.array_equal(R._to_the_left(h, m), whole) and (whole <= m).all() and 400 < whole[6] < 600


def test_bootstrap_is_even():
    """Each place is drawn as often as any other, and counts vary as those of single draws would."""
    counts = np.array(drawn(11, 600, 77))
    assert np.abs(counts.mean(axis=0) - 1).max() < 5 * math.sqrt((1 - 1 / 11) / 600)
    assert abs(counts.var() - (1 - 1 / 11)) < 0.08


def test_permuted_class_means_and_correlations(spark):
    rng = random.Random(4)
    units = [f"u{k:02}" for k in range(12)]
    classes = {u: f"c{k % 3}" for k, u in enumerate(units)}
    pairs = [(a, b, rng.random()) for a in units for b in units if a < b]
    dealt = {r["unit"]: r["dealt"] for r in R.permutations(spark.createDataFrame([(u,) for u in units], "unit string"), 30).collect()}
    got = {r["rep"]: (r["within"], r["ratio"]) for r in R.permuted_class_means(spark.createDataFrame(pairs, "a string, b string, d double").repartition(3), spark.createDataFrame(list(classes.items()), "unit string, class string"), 30).collect()}
    for rep in range(1, 31):
        of = {u: classes[units[dealt[u][rep - 1] - 1]] for u in units}
        inside = [d for a, b, d in pairs if of[a] == of[b]]
        across = [d for a, b, d in pairs if of[a] != of[b]]
        assert math.isclose(got[rep][0], statistics.fmean(inside)) and math.isclose(got[rep][1], statistics.fmean(inside) / statistics.fmean(across))
    rows = [("d", u, rng.choice([1.0, 2.0, 3.0, 4.0]), float(k)) for k, u in enumerate(units)] + [("flat", u, 1.0, float(k)) for k, u in enumerate(units)] + [("few", u, float(k), float(k)) for k, u in enumerate(units[:5])]
    null = R.permuted_correlations(spark.createDataFrame(rows, "dimension string, unit string, x double, z double"), ["dimension"], "x", "z", 30).collect()
    rho = {r["rep"]: r["rho"] for r in null if r["dimension"] == "d"}
    ranks = {u: statistics.fmean(i + 1 for i, v in enumerate(sorted(x for g, _, x, _ in rows if g == "d")) if v == y) for g, u, y, _ in rows if g == "d"}
    assert all(math.isclose(rho[k], statistics.correlation([ranks[u] for u in units], [float(dealt[u][k - 1]) for u in units])) for k in rho) and len(rho) == 30
    assert all(r["rho"] is None for r in null if r["dimension"] != "d")


def test_permuted_medians(spark):
    units = [f"u{k}" for k in range(7)]
    ranks = [(a, b, (3 * i + 5 * j) % 7 + 1) for i, a in enumerate(units) for j, b in enumerate(units)]
    dealt = {r["unit"]: r["dealt"] for r in R.permutations(spark.createDataFrame([(u,) for u in units], "unit string"), 9).collect()}
    got = {r["rep"]: r["median"] for r in R.permuted_medians(spark.createDataFrame(ranks, "unit string, other string, rank int"), 9).collect()}
    at = {(a, b): r for a, b, r in ranks}
    assert got == {k: statistics.median(at[u, units[dealt[u][k - 1] - 1]] for u in units) for k in range(1, 10)}


@pytest.mark.parametrize("p", [0, 1, 2, 4, 7])
def test_least_squares_of_any_width(spark, p):
    rng = np.random.default_rng(p)
    xs, rows = [f"x{k}" for k in range(p)], []
    for g in ("a", "b"):
        x = rng.normal(3, 2, (40, p))
        rows += [(g, *map(float, v), float(y)) for v, y in zip(x, x @ np.arange(1, p + 1) + rng.normal(0, 0.5, 40) + 9, strict=True)]
    df = spark.createDataFrame([*rows, ("a", *[None] * p, 1.0) if p else ("a", None)], ", ".join(["g string", *(f"{x} double" for x in xs), "y double"]))
    got = {(r["g"], r["term"]): (r["b"], r["se"], r["n"]) for r in T.least_squares(df, ["g"], xs, "y", pooled=True).collect()}
    assert len(got) == 3 * (p + 1)
    for g in ("a", "b", None):
        own = [r for r in rows if g in (None, r[0])]
        x, y = np.array([[1.0, *r[1:-1]] for r in own]), np.array([r[-1] for r in own])
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * ((y - x @ b) ** 2).sum() / (len(own) - p - 1))
        for k, term in enumerate(["const", *xs]):
            assert math.isclose(got[g, term][0], b[k], rel_tol=1e-7) and math.isclose(got[g, term][1], se[k], rel_tol=1e-7) and got[g, term][2] == len(own)


def test_least_squares_of_dependent_columns(spark):
    rows = [("twice", float(k), 2.0 * k, float(k * k)) for k in range(9)] + [("flat", float(k), 1.0, float(k)) for k in range(9)] + [("full", float(k), float(k * k), float(k)) for k in range(3)]
    got = {(r["g"], r["term"]): (r["b"], r["se"]) for r in T.least_squares(spark.createDataFrame(rows, "g string, a double, b double, y double"), ["g"], ["a", "b"], "y").collect()}
    assert all(v == (None, None) for (g, _), v in got.items() if g != "full")
    assert math.isclose(got["full", "a"][0], 1.0) and got["full", "a"][1] is None
