"""Hand-made cases: zero mass, single and unordered options, ties, constants, empty cells, properties of the metrics."""

import math

import pytest
from pyspark.sql import functions as F

from popmeasure.functions import columns as C
from popmeasure.operators import distances as G
from popmeasure.operators import distributions as D
from popmeasure.operators import metrics as M
from popmeasure.operators import pairs as P
from popmeasure.operators import quality as K
from popmeasure.operators import resampling as R
from popmeasure.operators import statistics as T
from popmeasure.operators import summaries as S
from popmeasure.sources import files


def one(df):
    return df.first().asDict()


def metric(spark, cells):
    return one(M.item_metrics(spark.createDataFrame([("c", float(v), float(p), float(q)) for v, p, q in cells], "c string, value double, p double, q double"), ["c"]))


def test_equal_distributions_have_no_distance(spark):
    r = metric(spark, [(1, 0.25, 0.25), (2, 0.75, 0.75)])
    assert r["tvd"] == r["jsd"] == r["brier"] == r["wasserstein"] == 0 and r["top_match"]


def test_zero_mass_options(spark):
    r = metric(spark, [(1, 1.0, 0.0), (3, 0.0, 1.0)])
    assert r["tvd"] == 1 and math.isclose(r["jsd"], math.log(2)) and r["wasserstein"] == 2 and r["mean_error"] == 2
    assert math.isclose(r["cross_entropy"], -math.log(1e-12))


def test_single_option(spark):
    r = metric(spark, [(5, 1.0, 1.0)])
    assert r["wasserstein"] == 0 and r["std_p"] == 0 and r["n_options"] == 1


def test_modal_tie_takes_the_first_option(spark):
    assert metric(spark, [(1, 0.5, 0.4), (2, 0.5, 0.6)])["mode_p"] == 1


def test_unordered_items_have_null_moments(spark):
    rows = spark.createDataFrame([("c", 1.0, 0.5, 0.2), ("c", 2.0, 0.5, 0.8)], "c string, value double, p double, q double")
    r = one(M.item_metrics(rows, ["c"], F.lit(False)))
    assert r["wasserstein"] is None and r["mean_error"] is None and r["tvd"] is not None


def test_weights_that_are_not_above_zero_count_for_nothing(spark):
    rows = spark.createDataFrame([("u", "i", 1.0, 2.0), ("u", "i", 2.0, float("nan")), ("u", "i", 2.0, -1.0), ("u", "i", 2.0, None), ("u", "i", -1.0, 5.0)], "unit string, item string, value double, weight double")
    assert [tuple(r) for r in D.distribution(rows, ["unit"]).select("value", "prob", "n_valid").collect()] == [(1.0, 1.0, 1)]


def test_grid_keeps_options_that_nobody_chose(spark):
    rows = spark.createDataFrame([("u", "i", 1.0, 2.0)], "unit string, item string, value double, weight double")
    grid = spark.createDataFrame([("i", 1.0), ("i", 2.0)], "item string, value double")
    assert sorted(tuple(r) for r in D.grid_distribution(rows, ["unit"], grid).select("value", "prob").collect()) == [(1.0, 1.0), (2.0, 0.0)]


def test_temperature_of_one_changes_nothing_and_the_mode_stays(spark):
    rows = spark.createDataFrame([("c", 1.0, 0.2), ("c", 2.0, 0.5), ("c", 3.0, 0.3)], "c string, value double, prob double")
    got = D.temperature_sweep(rows, ["c"], [1, 3]).collect()
    assert all(math.isclose(r["prob"], {1.0: 0.2, 2.0: 0.5, 3.0: 0.3}[r["value"]]) for r in got if r["temperature"] == 1)
    assert max((r for r in got if r["temperature"] == 3), key=lambda r: r["prob"])["value"] == 2


@pytest.mark.parametrize(("mean", "ends"), [(3.1, None), (1.0, 1.0), (5.0, 5.0)])
def test_max_entropy_has_the_mean(spark, mean, ends):
    grid = spark.createDataFrame([("c", float(v), mean) for v in range(1, 6)], "c string, value double, mean double")
    got = D.max_entropy(grid, ["c"], "value", "mean").collect()
    assert math.isclose(sum(r["prob"] * r["value"] for r in got), mean, abs_tol=1e-9)
    if ends:
        assert [r["prob"] for r in got if r["value"] == ends] == [1.0]


def test_fixation_lies_between_zero_and_one(spark):
    f = lambda *x: one(spark.range(1).select(G.fixation(*(F.lit(v) for v in x)).alias("f")))["f"]
    assert f(1.0, 1.0, 1.0, 1.0) == 0 and f(0.0, 0.0, 1.0, 1.0) == 1 and 0 < f(0.4, 0.4, 0.6, 0.6) < 1


def test_calibration_edges_are_closed_on_the_right(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.1, 0.0), (0.3, 1.0), (1.0, 1.0)], "q double, p double").withColumn("g", F.lit(1))
    assert sorted((r["bin"], r["n"]) for r in M.calibration_bins(rows, ["g"]).collect()) == [(0, 2), (2, 1), (9, 1)]


def test_constant_sides_have_no_correlation(spark):
    rows = spark.createDataFrame([(1, float(k), 2.0) for k in range(9)], "g int, x double, y double")
    assert one(T.spearman(rows, ["g"], "x", "y"))["rho"] is None


def test_ties_share_ranks(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (1, None)], "g int, x double")
    assert sorted(str(r["rank_x"]) for r in S.average_ranks(rows, ["g"], ["x"]).collect()) == ["1.5", "1.5", "3.0", "None"]


def test_bootstrap_holds_the_mean(spark):
    rows = spark.createDataFrame([("g", k, float(k)) for k in range(20)], "g string, k int, x double")
    r = one(R.bootstrap_mean(rows, ["g"], "x", ["k"], 200))
    assert r["low"] < r["mean"] < r["high"] and r["n"] == 20


def test_permutations_keep_labels(spark):
    units = spark.createDataFrame([(f"u{k}",) for k in range(9)], "unit string")
    got = [r["dealt"] for r in R.permutations(units, 5).collect()]
    assert all(sorted(d[k] for d in got) == list(range(1, 10)) for k in range(5)) and len({tuple(d[k] for d in got) for k in range(5)}) == 5


def test_least_squares_recovers_coefficients(spark):
    rows = spark.createDataFrame([(1, float(a), float(b), 2 + 3.0 * a - b) for a in range(5) for b in range(4)], "g int, a double, b double, y double")
    got = {r["term"]: r["b"] for r in T.least_squares(rows, ["g"], ["a", "b"], "y").collect()}
    assert all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in {"const": 2, "a": 3, "b": -1}.items())


def test_zero_is_positive_and_conflicts_stop(spark):
    pair = [("d", "p", "A text", "B text", 0.8, 0.2, 0), ("d", "p", "A text", "B text", 0.8, 0.2, 1)]
    schema = "dimension string, prompt string, response_a string, response_b string, m_a double, m_b double, seq int"
    bank = P.bank(spark.createDataFrame(pair, schema), ["dimension", "prompt"], ["seq"])
    anchors = spark.createDataFrame([("X", "d", 0.0), ("Y", "d", -0.4)], "unit string, dimension string, z double")
    got = {r["unit"]: (r["chosen"], r["m_diff_signed"]) for r in P.label_pairs(bank, anchors).collect()}
    assert got == {"X": ("A text", 0.6), "Y": ("B text", -0.6)}
    other = P.bank(spark.createDataFrame([*pair, ("d", "p", "other", "B text", 0.8, 0.2, 2)], schema), ["dimension", "prompt"], ["seq"])
    with pytest.raises(Exception, match="different texts"):
        P.without_conflicts(other).collect()


def test_gates(spark):
    rows = spark.createDataFrame([(0.35, 0.9, 0.2), (0.35, 0.49, 0.5), (-0.35, 0.9, 0.2), (0.35, None, 0.2)], "z double, m_chosen double, m_rejected double")
    assert [r["qc_status"] for r in P.quality_gates(rows).collect()] == ["pass", "dist_fail", "mono_fail", "score_fail"]
    assert P.quality_gates(rows, least=0.0).collect()[1]["qc_status"] == "pass"


def test_contamination_of_equal_scores_is_null(spark):
    m = lambda *v: F.create_map(*(F.lit(x) for k, s in zip("tab", v, strict=True) for x in (k, s)))
    got = one(spark.range(1).select(P.contamination(m(0.2, 0.5, 0.5), m(0.9, 0.2, 0.2), F.lit("t")).alias("r"), P.contamination(m(0.2, 0.5, 0.5), m(0.2, 0.2, 0.2), F.lit("t")).alias("n")))
    assert got == {"r": 0.8571, "n": None}


def test_nearest_choice_and_its_ties(spark):
    rows = spark.createDataFrame([(3, 2, -2), (0, 3, -3), (0, -1, 3), (-3, 2, -2)], "t int, a int, b int")
    got = [r[0] for r in rows.select(P.nearest_choice(F.col("t"), F.col("a"), F.col("b"))).collect()]
    assert got == ["A", "A", "A", "B"]
    assert rows.select(P.nearest_choice(F.col("t"), F.col("a"), F.col("b"), False)).collect()[1][0] == "tie"


def test_codes(spark):
    rows = spark.createDataFrame([(1.0,), (2.5,), (None,)], "x double")
    assert [r[0] for r in rows.select(C.canonical_code(F.col("x"))).collect()] == ["1", "2.5", None]
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([(float("inf"),)], "x double").select(C.canonical_code(F.col("x"))).collect()


def test_json_is_repaired_or_set_aside(spark):
    rows = spark.createDataFrame([('```json\n{"a": 1,}\n```',), ("text {\"a\": 2} more",), ("none",), (None,), ("{bad",), ("{bad}",)], "raw string")
    got = [(r["reason"], r["parsed"]["a"] if r["reason"] is None else None) for r in K.normalised_answers(rows, "raw", "a int").collect()]
    assert got == [(None, 1), (None, 2), ("no object", None), ("empty", None), ("no object", None), ("not JSON", None)]


def test_join_contract(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    with pytest.raises(Exception, match="repeated"):
        K.many_to_one(left, right, ["k"]).collect()
    with pytest.raises(Exception, match="lose rows"):
        K.many_to_one(left, right.where("k = 1"), ["k"]).collect()


def test_expectations_can_stop(spark):
    rows = spark.createDataFrame([(1,), (None,)], "k int")
    assert one(K.expect(rows, {"known": F.col("k").isNotNull()})) == {"check": "known", "passed": False, "observed": 1}
    with pytest.raises(Exception, match="broken: known"):
        K.expect(rows, {"known": F.col("k").isNotNull()}, stop=True).collect()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="nope"):
        files.require(spark.range(1), ["id", "nope"])


def test_skew_does_not_change_results(spark):
    """One unit with nine tenths of all rows."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("unit"), F.lit("i").alias("item"), (F.col("id") % 7).cast("double").alias("value"), F.lit(1.0).alias("weight"))
    got = D.distribution(rows, ["unit"]).groupBy("unit").agg(F.sum("prob").alias("p"), F.first("n_valid").alias("n")).collect()
    assert {r["unit"]: (round(r["p"], 9), r["n"]) for r in got} == {"small": (1.0, 2000), "large": (1.0, 18000)}


def plane_of(rows, axes=2):
    """Units, centred means and axes by a singular value decomposition."""
    import numpy as np

    units = sorted({u for u, _, _ in rows})
    items = sorted(i for i in {i for _, i, _ in rows} if sum(j == i for _, j, _ in rows) == len(units))
    at = {(u, i): m for u, i, m in rows}
    x = np.array([[at[u, i] for i in items] for u in units])
    vt = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:axes]
    return units, items, x.mean(0), vt * np.sign(vt[range(axes), np.abs(vt).argmax(1)])[:, None]


def test_plane_and_projection_as_by_hand(spark):
    import numpy as np

    rows = [(f"u{k}", f"i{j}", float((k * 7 + j * j * 3 + k * j * 5) % 11)) for k in range(6) for j in range(5) if (k, j) != (2, 4)]
    units, items, center, axes = plane_of(rows)
    assert items == ["i0", "i1", "i2", "i3"]  # one unit lacks i4
    means = spark.createDataFrame(rows, "unit string, item string, mean double")
    plane = G.principal_plane(means)
    at = {(u, i): m for u, i, m in rows}
    got = {r["unit"]: (r["x1"], r["x2"], r["n_items"]) for r in G.projected(means, plane).collect()}
    for u in units:
        assert np.allclose(got[u][:2], axes @ (np.array([at[u, i] for i in items]) - center)) and got[u][2] == 4
    policy = spark.createDataFrame([("p", "i1", 4.0), ("p", "i3", 2.0), ("p", "i4", 9.0)], "policy string, item string, mean double")
    r = G.projected(policy, plane, "policy").first()
    assert np.allclose([r["x1"], r["x2"]], axes[:, [1, 3]] @ (np.array([4.0, 2.0]) - center[[1, 3]])) and r["n_items"] == 2


def test_scaling_gives_back_distances_in_a_plane(spark):
    at = {f"u{k}": (math.cos(k * k), k % 3 + math.sin(k)) for k in range(7)}
    pairs = spark.createDataFrame([(a, b, math.dist(at[a], at[b])) for a in at for b in at if a < b], "a string, b string, d double")
    got = {r["unit"]: (r["x1"], r["x2"]) for r in G.classical_scaling(pairs).collect()}
    assert all(math.isclose(math.dist(got[a], got[b]), math.dist(at[a], at[b]), abs_tol=1e-9) for a in at for b in at)


def test_axes_by_power_iteration(spark):
    """Distances that no space has: some eigenvalues are below 0. The same places as by the whole matrix."""
    import random

    rng = random.Random(6)
    units = [f"u{k:02}" for k in range(14)]
    at = {u: [rng.gauss(0, s) for s in (3, 2, 0.6, 0.3)] for u in units}
    pairs = spark.createDataFrame([(a, b, math.dist(at[a], at[b]) * rng.uniform(0.9, 1.1)) for a in units for b in units if a < b], "a string, b string, d double")
    one, two = ({r["unit"]: (r["x1"], r["x2"]) for r in G.classical_scaling(pairs, most=m).collect()} for m in (2000, 3))
    assert all(math.isclose(math.dist(one[a], one[b]), math.dist(two[a], two[b]), rel_tol=1e-4) for a in units for b in units if a < b)


def test_answers_are_counted_once_and_null_is_not_valid(spark):
    answers = spark.createDataFrame([("p", "u", "i", "1", True, 1), ("p", "u", "i", "9", False, 2), ("p", "u", "j", None, False, 1), ("p", "v", "k", "1", None, 1)], "policy string, unit string, item string, answer string, truncated boolean, at int")
    spec = spark.createDataFrame([("i", ["1", "2"]), ("j", ["1"])], "item string, codes array<string>")
    got = {r["unit"]: tuple(r)[2:] for r in K.answer_validity(answers, spec, ["at"]).collect()}
    assert got == {"u": (2, 1, 0.5, 1), "v": (1, 0, 0.0, 0)}


def test_incomplete_tables_are_not_given(spark):
    rows = spark.createDataFrame([("a", "u"), ("a", "v"), ("b", "u")], "cell string, unit string")
    wanted = spark.createDataFrame([("a", "u"), ("a", "v"), ("b", "u"), ("b", "v")], "cell string, unit string")
    lacking = K.missing_cells(rows, ["cell", "unit"], wanted)
    assert [tuple(r) for r in lacking.collect()] == [("b", "v")]
    assert K.complete_only(rows, lacking).count() == 0
    assert K.complete_only(rows, K.missing_cells(rows, ["cell", "unit"], wanted.where("unit = 'u'"))).count() == 3


def test_export_nests_and_carries_profiles(spark):
    rows = spark.createDataFrame([("u", k, "pass" if k % 4 else "dist_fail") for k in range(20)] + [("v", 1, "pass")], "unit string, k int, qc_status string")
    profiles = spark.createDataFrame([("u", "risk", 1.0), ("u", "trust", -1.0)], "unit string, dimension string, z double")
    got = P.nested_export(rows, profiles, [3, 30], "k", "r", "t", "s").collect()
    small, large = ({r["k"] for r in got if r["unit"] == "u" and r["sample_size"] == n} for n in (3, 30))
    assert len(small) == 3 and small < large == {k for k in range(20) if k % 4}
    assert all(r["profile"] == ({"risk": 1.0, "trust": -1.0} if r["unit"] == "u" else None) for r in got) and sum(r["unit"] == "v" for r in got) == 2


def test_columns_in_the_order_in_which_they_first_come(spark):
    assert files.union_of_columns(["b", "a"], ["c", "a"], ["b", "d"]) == ["b", "a", "c", "d"]
    a, b = spark.createDataFrame([(1, 2)], "B int, a int"), spark.createDataFrame([(3, 4)], "c int, b int")
    out = files.waves([a, b])
    assert out.columns == ["b", "a", "c"] and {tuple(r) for r in out.collect()} == {(1, 2, None), (4, None, 3)}
    assert [tuple(r) for r in files.column_report(a, ["a", "z"]).collect()] == [("a", True, 1), ("z", False, None)]


def test_keys_with_several_texts_are_flagged(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, versions int")
    assert {tuple(r) for r in P.flagged_conflicts(rows).select("k", "conflict").collect()} == {("a", False), ("b", True)}
