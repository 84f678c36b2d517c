"""Queries of summaries, ranks, distances, statistics and resampling."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import distances as G
from ..operators import pairs as P
from ..operators import resampling as R
from ..operators import statistics as T
from ..operators import summaries as S
from ..sources.shared import written
from . import fixtures as X
from .registry import register

METRICS = ["tvd", "jsd", "brier", "cross_entropy", "abs_mean_error", "wasserstein"]
LONG = "SELECT policy, unit, item, dimension, relationship, metric, value FROM evaluated UNPIVOT INCLUDE NULLS (value FOR metric IN (tvd, jsd, brier, cross_entropy, abs_mean_error, wasserstein))"
CANDIDATES = "SELECT e.*, " + ", ".join(f"b.{m} AS base_{m}" for m in [*METRICS, "mean_error"]) + " FROM evaluated e JOIN evaluated b ON b.policy = 'base' AND e.policy <> 'base' AND e.unit = b.unit AND e.item = b.item"


def baseline(s, d):
    rows = X.evaluated(s, d)
    return S.against_baseline(rows, ["unit", "item"], [*METRICS, "mean_error"])


# Summaries
register("a13_weighted_mean", lambda s, d: S.weighted_mean(X.missing(s, d).withColumn("value", C.mask_missing(F.col("value"))), ["unit", "item"], least=30), "SELECT * FROM (SELECT unit, item, sum(value * weight) / sum(weight) AS mean, count(*) AS n FROM missing WHERE value >= 0 AND weight > 0 GROUP BY 1, 2) WHERE n >= 30", "missing", "mean")
register("a14_composites", lambda s, d: S.composites(X.means(s, d).withColumn("dimension", X.lookup(F.col("item"), X.DIMENSIONS)), ["unit"]), f"SELECT unit, {X.sql_lookup('item', X.DIMENSIONS)} AS dimension, avg(mean) AS composite, count(*) AS n_items FROM means GROUP BY 1, 2", "means", "composite")
register("a15_a16_metric_summary", lambda s, d: S.summary(S.metric_rows(X.evaluated(s, d), ["relationship", "dimension"], METRICS), ["relationship", "dimension", "metric"]), f"SELECT relationship, dimension, metric, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std, count(value) AS n FROM ({LONG}) GROUP BY 1, 2, 3", "evaluated", "mean median std")
register(
    "a17_a18_signed_moments",
    lambda s, d: X.evaluated(s, d).groupBy("policy", F.coalesce(F.nullif(F.trim("dimension"), F.lit("")), F.lit("Unspecified")).alias("dimension")).agg(F.avg("mean_error").alias("mean_error"), F.avg("std_error").alias("std_error"), F.percentile("mean_error", 0.5).alias("median_error"), F.avg(F.col("top_match").cast("double")).alias("match_rate"), F.count_distinct("item").alias("items"), F.count("mean_error").alias("n")),
    "SELECT policy, dimension, avg(mean_error) AS mean_error, avg(std_error) AS std_error, quantile_cont(mean_error, 0.5) AS median_error, avg(CASE WHEN top_match THEN 1.0 ELSE 0.0 END) AS match_rate, count(DISTINCT item) AS items, count(mean_error) AS n FROM evaluated GROUP BY 1, 2",
    "evaluated",
    "mean_error std_error median_error match_rate",
)
register("a19_items_per_dimension", lambda s, d: X.evaluated(s, d).select("item", "dimension", "class", "is_ordered").dropDuplicates(["item"]).groupBy("dimension").agg(F.count_distinct("item").alias("items"), F.count_distinct("class").alias("classes"), F.count_if("is_ordered").alias("ordered")), "SELECT dimension, count(DISTINCT item) AS items, count(DISTINCT class) AS classes, count(*) FILTER (is_ordered) AS ordered FROM (SELECT DISTINCT item, dimension, class, is_ordered FROM evaluated) GROUP BY 1", "evaluated")
register("j3_a20_improvement", lambda s, d: S.improvements(baseline(s, d), ["policy"], METRICS), "SELECT policy, metric, avg(gain) AS mean_gain, avg(CASE WHEN gain > 0 THEN 1.0 WHEN gain <= 0 THEN 0.0 END) AS share_better, count(gain) AS n FROM (SELECT policy, " + ", ".join(f"base_{m} - {m} AS {m}" for m in METRICS) + f" FROM ({CANDIDATES})) UNPIVOT INCLUDE NULLS (gain FOR metric IN ({', '.join(METRICS)})) GROUP BY 1, 2", "evaluated", "mean_gain share_better")
register("a20_null_as_false", lambda s, d: S.improvements(baseline(s, d), ["policy"], METRICS, null_as_false=True), "SELECT policy, metric, avg(gain) AS mean_gain, avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END) AS share_better, count(gain) AS n FROM (SELECT policy, " + ", ".join(f"base_{m} - {m} AS {m}" for m in METRICS) + f" FROM ({CANDIDATES})) UNPIVOT INCLUDE NULLS (gain FOR metric IN ({', '.join(METRICS)})) GROUP BY 1, 2", "evaluated", "mean_gain share_better")
def specificity_of_all(s, d):
    """Every unit's matched policy against each of the cross policies on it."""
    rows = X.evaluated(s, d)
    rivals = rows.where("relationship = 'cross'").select("unit", F.col("policy").alias("rival")).distinct()
    paired = rows.join(rivals, "unit").where("relationship = 'matched' or (relationship = 'cross' and policy = rival)")
    return S.specificity(paired, ["unit", "item", "rival"], "tvd").withColumnRenamed("cross", "crossed")


register(
    "j4_a21_specificity",
    lambda s, d: specificity_of_all(s, d),
    "SELECT m.unit, m.item, c.policy AS rival, m.tvd AS matched, c.tvd AS crossed, 1 AS n_cross, c.tvd - m.tvd AS advantage FROM evaluated m JOIN evaluated c USING (unit, item) WHERE m.relationship = 'matched' AND c.relationship = 'cross'",
    "evaluated",
    "matched crossed advantage",
    "n_cross",
)
register(
    "a24_matched_and_cross",
    lambda s, d: S.matched_and_cross(X.evaluated(s, d), ["unit", "dimension"], "tvd"),
    """SELECT unit, dimension, matched, mean_cross, best_cross, n_cross, mean_cross - matched AS over_mean, best_cross - matched AS over_best FROM (SELECT unit, dimension, max(m) FILTER (relationship = 'matched') AS matched, avg(m) FILTER (relationship = 'cross') AS mean_cross, min(m) FILTER (relationship = 'cross') AS best_cross,
    count(*) FILTER (relationship = 'cross') AS n_cross FROM (SELECT unit, dimension, policy, relationship, avg(tvd) AS m FROM evaluated WHERE relationship <> 'base' GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) WHERE matched IS NOT NULL""",
    "evaluated",
    "matched mean_cross best_cross over_mean over_best",
)
register(
    "a25_a28_layers",
    lambda s, d: X.evaluated(s, d).groupBy("class").pivot("relationship", ["base", "matched", "cross"]).agg(F.avg("tvd")).withColumn("delta", F.col("matched") - F.col("base")).withColumnRenamed("cross", "crossed"),
    "SELECT class, base, matched, crossed, matched - base AS delta FROM (SELECT class, avg(tvd) FILTER (relationship = 'base') AS base, avg(tvd) FILTER (relationship = 'matched') AS matched, avg(tvd) FILTER (relationship = 'cross') AS crossed FROM evaluated GROUP BY 1)",
    "evaluated",
    "base matched crossed delta",
)


def direction(s, d):
    z = X.anchors(s, d).where("dimension <> 'amount'")
    return S.direction_cells(baseline(s, d).where("mean_error is not null").join(F.broadcast(z), ["unit", "dimension"]))


DIRECTION = f"SELECT policy, unit, item, mean_error - base_mean_error AS movement, abs(mean_error) < abs(base_mean_error) AS shrunk, sign(mean_error - base_mean_error) = sign(z) AND abs(mean_error - base_mean_error) > 1e-9 AS z_aligned FROM ({CANDIDATES}) c JOIN anchors USING (unit, dimension) WHERE mean_error IS NOT NULL"
register("a26_direction", lambda s, d: direction(s, d).select("policy", "unit", "item", "movement", "shrunk", "z_aligned"), DIRECTION, "evaluated anchors", "movement")
register("a27_sign_shares", lambda s, d: S.share_of_cells(direction(s, d), ["policy"], ["shrunk", "z_aligned"]), f"SELECT policy, avg(shrunk::INT) AS shrunk, avg(z_aligned::INT) AS z_aligned, count(*) AS n FROM ({DIRECTION}) GROUP BY 1", "evaluated anchors", "shrunk z_aligned")
register(
    "a29_contrast",
    lambda s, d: S.contrast(X.evaluated(s, d), ["policy", "unit"], "class", "near", "far"),
    """SELECT policy, unit, people, policy_contrast, abs(policy_contrast) < abs(people) AS compressed, policy_contrast / people AS ratio FROM (SELECT policy, unit, avg(mean_p) FILTER (class = 'near') - avg(mean_p) FILTER (class = 'far') AS people, avg(mean_q) FILTER (class = 'near') - avg(mean_q) FILTER (class = 'far') AS policy_contrast FROM evaluated GROUP BY 1, 2)""",
    "evaluated",
    "people policy_contrast ratio",
)
register("a30_b6_pooled", lambda s, d: S.pooled(X.evaluated(s, d), ["relationship"], "unit", "wasserstein"), "SELECT relationship, sum(s) / sum(n) AS item_pooled, avg(s / n) AS unit_pooled, sum(n) AS n FROM (SELECT relationship, unit, sum(wasserstein) AS s, count(wasserstein) AS n FROM evaluated GROUP BY 1, 2) GROUP BY 1", "evaluated", "item_pooled unit_pooled", "n")


def one_universe(s, d):
    """Families re-pooled on the items that every policy has an answer to: base leaves out I6, and some adapters I3."""
    rows = X.evaluated(s, d).where("not (policy = 'base' and item = 'I6') and not (policy = 'N03_adapter' and item = 'I3')")
    return S.like_for_like(rows, "relationship", "policy", "item", ["tvd", "jsd", "entropy_error", "std_error", "top_match"])


register(
    "b6_like_for_like",
    one_universe,
    """SELECT relationship, count(*) AS policies, avg(tvd) AS tvd, avg(jsd) AS jsd, avg(entropy_error) AS entropy_error, avg(std_error) AS std_error, avg(top_match) AS top_match, any_value(items) AS items FROM (SELECT relationship, policy, avg(tvd) AS tvd, avg(jsd) AS jsd, avg(entropy_error) AS entropy_error, avg(std_error) AS std_error, avg(top_match::INT) AS top_match
    FROM own JOIN shared USING (item) GROUP BY 1, 2), (SELECT count(*) AS items FROM shared) GROUP BY 1""".replace(" own ", " (SELECT * FROM evaluated WHERE NOT (policy = 'base' AND item = 'I6') AND NOT (policy = 'N03_adapter' AND item = 'I3')) ").replace(" shared", " (SELECT item FROM evaluated WHERE NOT (policy = 'base' AND item = 'I6') AND NOT (policy = 'N03_adapter' AND item = 'I3') GROUP BY item HAVING count(DISTINCT policy) = (SELECT count(DISTINCT policy) FROM evaluated)) shared"),
    "evaluated",
    "tvd jsd entropy_error std_error top_match",
)
register("a32_two_units", lambda s, d: S.two_units(X.answers(s, d), "N03", "N07"), "SELECT item, avg(value) FILTER (unit = 'N03') AS mean_a, avg(value) FILTER (unit = 'N07') AS mean_b, count(*) FILTER (unit = 'N03') AS n_a, count(*) FILTER (unit = 'N07') AS n_b, avg(value) FILTER (unit = 'N03') - avg(value) FILTER (unit = 'N07') AS difference, 'ok' AS status FROM answers WHERE unit IN ('N03', 'N07') GROUP BY 1", "answers", "mean_a mean_b difference")
register(
    "a23_guarded_correlation",
    lambda s, d: S.correlation_and_shift(X.evaluated(s, d), ["policy"], "base"),
    """SELECT policy, dimension, r, n, m - max(CASE WHEN policy = 'base' THEN m END) OVER (PARTITION BY dimension) AS delta_tvd FROM (SELECT policy, dimension, CASE WHEN count(a) >= 3 AND max(a) > min(a) AND max(b) > min(b) THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END AS r, count(a) AS n, avg(tvd) AS m
    FROM (SELECT *, round(mean_q, 9) AS a, round(mean_p, 9) AS b FROM evaluated) GROUP BY 1, 2)""",
    "evaluated",
    "r delta_tvd",
)
register("a39_log_covariate", lambda s, d: X.lines(s, d).groupBy("unit").agg(F.ln(F.avg("o_totalprice")).alias("log_mean"), F.avg("l_discount").alias("spread")), "SELECT unit, ln(avg(o_totalprice)) AS log_mean, avg(l_discount) AS spread FROM lines GROUP BY 1", "lines", "log_mean spread")
register("a40_usage_rollup", lambda s, d: X.table(s, d, "events").rollup("event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("tokens")), "SELECT event_type, count(*) AS calls, sum(value) AS tokens FROM events GROUP BY ROLLUP (event_type)", doubles="tokens")
register(
    "a41_facet_scores",
    lambda s, d: X.answers(s, d).where("item in ('I1', 'I7')").groupBy("unit", "item").agg(((F.avg("value") - 1) / F.when(F.col("item") == "I1", 6).otherwise(4)).alias("m"), F.count("*").alias("n")).join(X.anchors(s, d).where("dimension = 'trust' and unit < 'N20'").select("unit", F.col("z").alias("anchor")), "unit", "left"),
    "SELECT unit, item, (avg(value) - 1) / CASE item WHEN 'I1' THEN 6 ELSE 4 END AS m, count(*) AS n, max(z) AS anchor FROM answers LEFT JOIN (SELECT unit, z FROM anchors WHERE dimension = 'trust' AND unit < 'N20') a USING (unit) WHERE item IN ('I1', 'I7') GROUP BY unit, item",
    "answers anchors",
    "m anchor",
)
register("a42_top_messages", lambda s, d: S.top_messages(X.table(s, d, "part"), "p_type"), "SELECT p_type || ' (x' || count(*) || ')' AS message, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 5")

# Ranks and windows
register("w2_w3_own_unit_rank", lambda s, d: G.own_unit_rank(G.policy_unit_tvd(X.aligned(s, d)).where("policy <> 'base'").withColumn("d", F.round("d", 12)), F.col("policy") == F.concat("unit", F.lit("_adapter"))).drop("n"), """SELECT policy, max(r) FILTER (own) AS own_rank, max(d) FILTER (own) AS own_d, arg_min(unit, struct_pack(d := d, u := unit)) FILTER (NOT own) AS nearest_other, min(d) FILTER (NOT own) AS best_other, avg(d) FILTER (NOT own) AS mean_other, max(d) FILTER (own) - min(d) FILTER (NOT own) AS gap
    FROM (SELECT *, policy = unit || '_adapter' AS own, rank() OVER (PARTITION BY policy ORDER BY d) AS r FROM (SELECT policy, unit, round(avg(tvd), 12) AS d FROM evaluated WHERE policy <> 'base' GROUP BY 1, 2)) GROUP BY policy""", "evaluated", "own_d best_other mean_other gap")
register("w2_rank_kinds", lambda s, d: S.ranks(X.pairs(s, d).select("a", "b", F.round("d", 9).alias("d")), ["a"], "d", ["b"]), "SELECT a, b, round(d, 9) AS d, row_number() OVER (PARTITION BY a ORDER BY round(d, 9), b) AS rank_by_order, rank() OVER (PARTITION BY a ORDER BY round(d, 9)) AS rank_by_count FROM pairs", "pairs", "d")
register("w4_pair_standing", lambda s, d: G.pair_standing(X.pairs(s, d).select("a", "b", F.round("d", 9).alias("d"))), "SELECT a, b, round(d, 9) AS d, rank() OVER (ORDER BY round(d, 9)) AS rank, cume_dist() OVER (ORDER BY round(d, 9)) AS share FROM pairs", "pairs", "d share")
register("w7_average_ranks", lambda s, d: S.average_ranks(X.table(s, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], ["p_size"]).select("p_partkey", "rank_p_size"), "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS rank_p_size FROM part", doubles="rank_p_size")
register("w8_quantile_bins", lambda s, d: S.quantile_bins(X.table(s, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "bin"), "SELECT c_custkey, (c_acctbal > q[1])::INT + (c_acctbal > q[2])::INT AS bin FROM customer, (SELECT quantile_cont(c_acctbal, [1/3.0, 2/3.0]) AS q FROM customer)", ints="bin")
register("w9_nested_sample", lambda s, d: S.nested_sample(X.table(s, d, "customer").select("c_nationkey", "c_custkey"), ["c_nationkey"], "c_custkey", "seed").where("sample_rank <= 20"), "SELECT * FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5('seed|' || c_custkey), c_custkey) AS sample_rank FROM customer) WHERE sample_rank <= 20", ints="c_nationkey sample_rank")
register("w10_sequence_id", lambda s, d: X.table(s, d, "supplier").select("s_suppkey", F.format_string("N%02d_train_%04d", "s_nationkey", F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_name", "s_suppkey")) - 1).alias("id")), "SELECT s_suppkey, printf('N%02d_train_%04d', s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) - 1) AS id FROM supplier")
register("w11_latest", lambda s, d: X.table(s, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").cast("string").alias("at")).drop("at"), "SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS last_type FROM events GROUP BY 1")
register("w12_w13_widest", lambda s, d: G.euclidean_pairs(X.anchors(s, d).withColumn("z", F.round("z", 9)), least=3).withColumn("d", F.col("d")), "SELECT a, b, sqrt(sum(g * g)) AS d, count(*) FILTER (g > 0.3) AS n_strong, arg_max(dimension, struct_pack(g := g, k := dimension)) AS widest, count(*) FILTER (g > 0.3) >= 3 AS passes FROM (SELECT x.unit AS a, y.unit AS b, dimension, abs(round(x.z, 9) - round(y.z, 9)) AS g FROM anchors x JOIN anchors y USING (dimension) WHERE x.unit < y.unit) GROUP BY 1, 2", "anchors", "d")
register("w14_failure_gate", lambda s, d: S.failure_gate(X.table(s, d, "events"), ["user_id"], "event_id", F.col("event_type") == "error", 5, 0.5).select("event_id", "seen", "failure_share", "closed"), "SELECT event_id, seen, failure_share, seen >= 5 AND failure_share > 0.5 AS closed FROM (SELECT event_id, count(*) OVER w AS seen, avg((event_type = 'error')::INT) OVER w AS failure_share FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING))", doubles="failure_share")

# Distances
register("d1_item_fixation", lambda s, d: G.item_pairs(X.moments(s, d)), "SELECT x.unit AS a, y.unit AS b, item, CASE WHEN (x.mean_square + y.mean_square) / 2 - pow((x.mean + y.mean) / 2, 2) <= 1e-12 THEN 0 ELSE pow((x.mean - y.mean) / 2, 2) / ((x.mean_square + y.mean_square) / 2 - pow((x.mean + y.mean) / 2, 2)) END AS fst FROM moments x JOIN moments y USING (item) WHERE x.unit < y.unit AND x.grid = y.grid", "moments", "fst")
register("d2_population_distance", lambda s, d: X.pairs(s, d), "SELECT * FROM pairs", "pairs", "d")
register("d3_aligned_distance", lambda s, d: G.population_distance(G.item_pairs(X.moments(s, d), same_grid=False)), "SELECT a, b, avg(CASE WHEN t <= 1e-12 THEN 0 ELSE g / t END) AS d, count(*) AS n_items FROM (SELECT x.unit AS a, y.unit AS b, pow((x.mean - y.mean) / 2, 2) AS g, (x.mean_square + y.mean_square) / 2 - pow((x.mean + y.mean) / 2, 2) AS t FROM moments x JOIN moments y USING (item) WHERE x.unit < y.unit) GROUP BY 1, 2", "moments", "d")
register("d4_tvd_matrix", lambda s, d: G.policy_unit_tvd(X.aligned(s, d)), "SELECT policy, unit, avg(tvd) AS d, count(*) AS n_items FROM evaluated GROUP BY 1, 2", "evaluated", "d")
register("d5_z_scores", lambda s, d: X.anchors(s, d), "SELECT * FROM anchors", "anchors", "z")


def classes(s, d):
    return X.table(s, d, "nation").select(F.format_string("N%02d", "n_nationkey").alias("unit"), F.col("n_regionkey").cast("string").alias("class"))


WITHIN = "SELECT avg(d) FILTER (x.n_regionkey = y.n_regionkey) AS within, avg(d) FILTER (x.n_regionkey <> y.n_regionkey) AS between_, count(*) FILTER (x.n_regionkey = y.n_regionkey) AS n_within FROM pairs JOIN nation x ON a = printf('N%02d', x.n_nationkey) JOIN nation y ON b = printf('N%02d', y.n_nationkey)"
register("d7_class_means", lambda s, d: G.class_means(X.pairs(s, d), classes(s, d)).withColumnRenamed("between", "between_"), f"SELECT *, within / between_ AS ratio FROM ({WITHIN})", "pairs", "within between_ ratio")


def spread(s, d):
    z = X.anchors(s, d).withColumn("z", F.round("z", 9))
    return G.class_spread(classes(s, d), G.euclidean_pairs(z), z)


register(
    "d8_class_spread",
    spread,
    """SELECT class, n, members, mean_inside, max_gap, gap_dimension FROM (SELECT CAST(n_regionkey AS VARCHAR) AS class, count(*) AS n, string_agg(printf('N%02d', n_nationkey), ',' ORDER BY n_nationkey) AS members FROM nation GROUP BY 1)
    LEFT JOIN (SELECT class, avg(d) AS mean_inside FROM (SELECT CAST(m.n_regionkey AS VARCHAR) AS class, x.unit, y.unit, sqrt(sum(pow(round(x.z, 9) - round(y.z, 9), 2))) AS d FROM anchors x JOIN anchors y ON x.dimension = y.dimension AND x.unit < y.unit JOIN nation m ON x.unit = printf('N%02d', m.n_nationkey) JOIN nation o ON y.unit = printf('N%02d', o.n_nationkey)
    WHERE m.n_regionkey = o.n_regionkey GROUP BY 1, x.unit, y.unit) GROUP BY 1) USING (class)
    LEFT JOIN (SELECT class, max(g) AS max_gap, arg_min(dimension, struct_pack(g := -g, k := dimension)) AS gap_dimension FROM (SELECT CAST(n_regionkey AS VARCHAR) AS class, dimension, max(round(z, 9)) - min(round(z, 9)) AS g FROM anchors JOIN nation ON unit = printf('N%02d', n_nationkey) GROUP BY 1, 2) GROUP BY 1) USING (class)""",
    "anchors",
    "mean_inside max_gap",
)
register("d12_filled", lambda s, d: G.filled(X.pairs(s, d).withColumn("d", F.when(F.col("a") != "N03", F.col("d")))), "SELECT a, b, coalesce(CASE WHEN a <> 'N03' THEN d END, avg(CASE WHEN a <> 'N03' THEN d END) OVER ()) AS d, n_items FROM pairs", "pairs", "d")


def scaled(s, d):
    """Distances between units in the plane; axes may turn, distances may not."""
    at = G.classical_scaling(X.pairs(s, d))
    left, right = at.select(F.col("unit").alias("a"), F.col("x1").alias("p"), F.col("x2").alias("q")), at.select(F.col("unit").alias("b"), F.col("x1").alias("r"), F.col("x2").alias("t"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", F.sqrt(F.pow(F.col("p") - F.col("r"), 2) + F.pow(F.col("q") - F.col("t"), 2)).alias("d"))


def leading(matrix: str, name: str, steps: int = 1500) -> str:
    """SQL: table `name` with v, the leading eigenvector of a symmetric matrix m (a list of rows, one row of table `matrix`), by power iteration, and l, its value."""
    again = "[x / sqrt(list_dot_product(w, w)) FOR x IN w]"
    return f"""{name}_steps AS (SELECT 0 AS i, [1.0::DOUBLE / (1 + k) FOR k IN range(len(m))] AS v FROM {matrix} UNION ALL SELECT i + 1, {again} FROM (SELECT i, [list_dot_product(r, v) FOR r IN m] AS w FROM {name}_steps, {matrix} WHERE i < {steps})),
    {name} AS MATERIALIZED (SELECT v, list_dot_product(v, [list_dot_product(r, v) FOR r IN m]) AS l FROM {name}_steps, {matrix} WHERE i = {steps})"""


register(
    "d9_classical_scaling",
    scaled,
    f"""WITH RECURSIVE sides AS MATERIALIZED (SELECT a, b, d FROM pairs UNION ALL SELECT b, a, d FROM pairs), names AS MATERIALIZED (SELECT unit, row_number() OVER (ORDER BY unit) AS k FROM (SELECT DISTINCT a AS unit FROM sides)),
    squares AS (SELECT x.k AS i, y.k AS j, coalesce(d * d, 0) AS s FROM names x CROSS JOIN names y LEFT JOIN sides ON a = x.unit AND b = y.unit), centred AS (SELECT i, j, -0.5 * (s - avg(s) OVER (PARTITION BY i) - avg(s) OVER (PARTITION BY j) + avg(s) OVER ()) AS c FROM squares),
    cross1 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM centred GROUP BY i)), {leading("cross1", "axis1")},
    cross2 AS MATERIALIZED (SELECT [[m[p][q] - l * v[p] * v[q] + CASE WHEN p = q THEN l ELSE 0 END FOR q IN range(1, len(m) + 1)] FOR p IN range(1, len(m) + 1)] AS m FROM cross1, axis1), {leading("cross2", "axis2")},
    spots AS (SELECT unit, x.v[k] * sqrt(greatest(x.l, 0)) AS x1, y.v[k] * sqrt(greatest(y.l - x.l, 0)) AS x2 FROM names, axis1 x, axis2 y) SELECT p.unit AS a, q.unit AS b, sqrt(pow(p.x1 - q.x1, 2) + pow(p.x2 - q.x2, 2)) AS d FROM spots p JOIN spots q ON p.unit < q.unit""",
    "pairs",
    "d",
)


def principal_axes(s, d, sums=None):
    """Units and policies in the plane of the units' principal axes."""
    sums = X.sums(s, d) if sums is None else sums
    means = X.means(s, d, sums)
    plane = G.principal_plane(means)
    policies = X.policies(s, d, sums).groupBy("policy", "item").agg(F.sum(F.col("prob") * F.col("value")).alias("mean"))
    return G.projected(means, plane).withColumnRenamed("unit", "name").union(G.projected(policies, plane, "policy"))


#: The plane of the units' principal axes, by power iteration and deflation: items with center, x1 and x2; of each axis the largest loading is above 0.
PLANE = f"""items AS MATERIALIZED (SELECT item, avg(mean) AS center, row_number() OVER (ORDER BY item) AS k FROM means GROUP BY item HAVING count(*) = (SELECT count(DISTINCT unit) FROM means)),
    cells AS (SELECT x.unit, i.k, x.mean - i.center AS away FROM means x JOIN items i USING (item)),
    cross1 AS MATERIALIZED (SELECT list(r ORDER BY k) AS m FROM (SELECT k, list(c ORDER BY j) AS r FROM (SELECT a.k, b.k AS j, sum(a.away * b.away) AS c FROM cells a JOIN cells b USING (unit) GROUP BY 1, 2) GROUP BY k)), {leading("cross1", "axis1")},
    cross2 AS MATERIALIZED (SELECT [[m[p][q] - l * v[p] * v[q] FOR q IN range(1, len(m) + 1)] FOR p IN range(1, len(m) + 1)] AS m FROM cross1, axis1), {leading("cross2", "axis2")},
    plane AS MATERIALIZED (SELECT item, center, a.v[k] * sign(a.v[list_position([abs(y) FOR y IN a.v], list_max([abs(y) FOR y IN a.v]))]) AS x1, b.v[k] * sign(b.v[list_position([abs(y) FOR y IN b.v], list_max([abs(y) FOR y IN b.v]))]) AS x2 FROM items, axis1 a, axis2 b),
    placed AS MATERIALIZED (SELECT name, sum((mean - center) * x1) AS x1, sum((mean - center) * x2) AS x2, count(*) AS n_items FROM (SELECT unit AS name, item, mean FROM means UNION ALL SELECT policy, item, sum(prob * value) FROM policies GROUP BY 1, 2) JOIN plane USING (item) GROUP BY name)"""
register("d10_principal_axes", principal_axes, f"WITH RECURSIVE {PLANE} SELECT name, x1, x2, n_items FROM placed", "means policies", "x1 x2")

# Statistics


def bridge(s, d):
    comp = S.composites(X.means(s, d).withColumn("dimension", X.lookup(F.col("item"), X.DIMENSIONS)), ["unit"])
    return comp.join(X.anchors(s, d), ["unit", "dimension"]).select("unit", "dimension", F.round("composite", 9).alias("composite"), F.round("z", 9).alias("z"))


BRIDGE = f"SELECT unit, dimension, round(composite, 9) AS composite, round(z, 9) AS z FROM (SELECT unit, {X.sql_lookup('item', X.DIMENSIONS)} AS dimension, avg(mean) AS composite FROM means GROUP BY 1, 2) JOIN anchors USING (unit, dimension)"
RANKED = f"SELECT *, rank() OVER (PARTITION BY dimension ORDER BY composite) + (count(*) OVER (PARTITION BY dimension, composite) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY dimension ORDER BY z) + (count(*) OVER (PARTITION BY dimension, z) - 1) / 2.0 AS ry FROM ({BRIDGE})"
register("r0_r5_bridge", lambda s, d: T.spearman(bridge(s, d), ["dimension"], "composite", "z"), f"SELECT dimension, corr(rx, ry) AS rho, count(*) AS n FROM ({RANKED}) GROUP BY 1", "means anchors", "rho")


def layer_bridge(s, d):
    """Item, class and whole composites of each dimension against its anchor; the spotlight items are the items' rows."""
    item = F.col("item")
    means = X.means(s, d).withColumn("dimension", X.lookup(item, X.DIMENSIONS))
    return T.layered_spearman(means, X.anchors(s, d), F.array(item, X.lookup(item, X.CLASSES), F.lit("all")))


LAYERS = f"SELECT unit, {X.sql_lookup('item', X.DIMENSIONS)} AS dimension, unnest([item, {X.sql_lookup('item', X.CLASSES)}, 'all']) AS layer, mean FROM means"
LAYERED = f"SELECT unit, dimension, layer, round(avg(mean), 9) AS x, round(max(z), 9) AS z FROM ({LAYERS}) JOIN anchors USING (unit, dimension) GROUP BY 1, 2, 3"
register("r6_item_bridge", layer_bridge, f"SELECT dimension, layer, CASE WHEN count(*) >= 8 THEN corr(rx, ry) END AS rho, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY dimension, layer ORDER BY x) + (count(*) OVER (PARTITION BY dimension, layer, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY dimension, layer ORDER BY z) + (count(*) OVER (PARTITION BY dimension, layer, z) - 1) / 2.0 AS ry FROM ({LAYERED})) GROUP BY 1, 2", "means anchors", "rho")


def covariates(s, d):
    wide = X.lines(s, d).groupBy("unit").agg(F.round(F.avg("l_discount"), 9).alias("x"), F.round(F.ln(F.avg("o_totalprice")), 9).alias("y"), F.round(F.avg("l_tax"), 9).alias("z"))
    return wide


register(
    "r2_r7_partial_correlation",
    lambda s, d: T.partial_spearman(covariates(s, d).withColumn("g", F.lit("all")), ["g"], "x", "y", "z"),
    """SELECT 'all' AS g, xy, xz, yz, n, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS partial FROM (SELECT corr(a, b) AS xy, corr(a, c) AS xz, corr(b, c) AS yz, count(*) AS n FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b,
    rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2.0 AS c FROM (SELECT unit, round(avg(l_discount), 9) AS x, round(ln(avg(o_totalprice)), 9) AS y, round(avg(l_tax), 9) AS z FROM lines GROUP BY unit)))""",
    "lines",
    "xy xz yz partial",
)
REPS = 2000
OWN = "SELECT relationship, round(tvd, 9) AS x, row_number() OVER (PARTITION BY relationship ORDER BY unit, item) - 1 AS i FROM evaluated WHERE relationship <> 'cross'"
register("r1_bootstrap", lambda s, d: R.bootstrap_mean(X.evaluated(s, d).where("relationship <> 'cross'").withColumn("tvd", F.round("tvd", 9)), ["relationship"], "tvd", ["unit", "item"], REPS), R.bootstrap_sql(OWN, ["relationship"], REPS), "evaluated", "mean low high")


def own_metrics(s, d):
    """What policies of a unit's own have on its items: one row an item and metric."""
    rows = S.metric_rows(X.evaluated(s, d).where("relationship = 'matched'"), ["unit", "item"], METRICS)
    return S.summary_with_interval(rows.withColumn("value", F.round("value", 9)), ["unit", "metric"], "value", ["item"], REPS)


OWN_METRICS = f"SELECT unit, item, metric, round(value, 9) AS value FROM ({LONG}) WHERE relationship = 'matched'"
INTERVALS = R.bootstrap_sql(f"SELECT unit, metric, value AS x, row_number() OVER (PARTITION BY unit, metric ORDER BY item) - 1 AS i FROM ({OWN_METRICS}) WHERE value IS NOT NULL", ["unit", "metric"], REPS)
register("a16_summary_with_interval", own_metrics, f"SELECT unit, metric, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS std, count(value) AS n, any_value(low) AS low, any_value(high) AS high FROM ({OWN_METRICS}) LEFT JOIN (SELECT unit, metric, low, high FROM ({INTERVALS})) USING (unit, metric) GROUP BY 1, 2", "evaluated", "mean median std low high")
register("r1_poisson_bootstrap", lambda s, d: T.poisson_mean(X.table(s, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice"), ["o_orderstatus"], "o_totalprice", "o_orderkey", 200), """SELECT o_orderstatus, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT o_orderstatus, rep, sum(w * o_totalprice) / sum(w) AS m FROM (SELECT o_orderstatus, rep, o_totalprice,
    POISSON AS w FROM (SELECT *, ('0x' || substr(md5('boot|' || o_orderkey || '|' || rep), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM orders, generate_series(1, 200) r(rep))) GROUP BY 1, 2) GROUP BY 1""".replace("POISSON", " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in T.poisson_cuts())), doubles="low high")
WILSON = "(p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS low, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS high"
register("r3_r4_accuracy", lambda s, d: T.accuracy(X.evaluated(s, d), ["policy"], F.col("top_match")), f"SELECT policy, p AS share, n, {WILSON} FROM (SELECT policy, avg(top_match::INT) AS p, count(*) AS n FROM evaluated GROUP BY 1)", "evaluated", "share low high")
register(
    "r4_reward_accuracy",
    lambda s, d: T.accuracy(P.implied_reward(X.rewards(s, d)), ["unit", "dimension"], F.col("prefers_chosen"), [["unit"], ["unit", "dimension"], ["dimension"]]),
    f"SELECT unit, dimension, p AS share, n, {WILSON} FROM (SELECT unit, dimension, avg((0.1::DOUBLE * ((chosen_logp - rejected_logp) - (ref_chosen_logp - ref_rejected_logp)) > 0)::INT) AS p, count(*) AS n FROM rewards GROUP BY GROUPING SETS ((unit), (unit, dimension), (dimension)))",
    "rewards",
    "share low high",
)
register("r8_linear_fit", lambda s, d: T.linear_fit(X.evaluated(s, d), ["policy"], "mean_p", "mean_q"), "SELECT policy, regr_slope(mean_q, mean_p) AS slope, regr_intercept(mean_q, mean_p) AS intercept, count(mean_q) AS n FROM evaluated GROUP BY 1", "evaluated", "slope intercept")


#: Deals of labels, and of anchors.
DEALS, ANCHOR_DEALS = 2000, 1000


def permuted_ratio(s, d):
    return R.permuted_class_means(X.pairs(s, d), classes(s, d), DEALS).select("rep", "within", "ratio")


PERMUTED = f"SELECT rep, u.unit, c.n_regionkey AS class FROM (SELECT rep, unit, row_number() OVER (PARTITION BY rep ORDER BY md5('perm|' || rep || '|' || unit), unit) AS i FROM (SELECT printf('N%02d', n_nationkey) AS unit FROM nation), generate_series(1, {DEALS}) r(rep)) u JOIN (SELECT n_regionkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) c USING (i)"
register("r9_label_permutation", permuted_ratio, f"SELECT x.rep, avg(d) FILTER (x.class = y.class) AS within, avg(d) FILTER (x.class = y.class) / avg(d) FILTER (x.class <> y.class) AS ratio FROM pairs JOIN ({PERMUTED}) x ON a = x.unit JOIN ({PERMUTED}) y ON b = y.unit AND x.rep = y.rep GROUP BY 1", "pairs", "within ratio")


def permuted_p(s, d):
    """The observed ratio, how often one by chance is as small, and the spread of those."""
    observed = G.class_means(X.pairs(s, d), classes(s, d)).select(F.round("ratio", 9).alias("observed"))
    null = permuted_ratio(s, d).select(F.round("ratio", 9).alias("ratio")).crossJoin(observed)
    return null.groupBy("observed").agg(*R.permutation_summary("ratio", F.col("observed"), less=True))


NULL_RATIOS = f"SELECT round(avg(d) FILTER (x.class = y.class) / avg(d) FILTER (x.class <> y.class), 9) AS ratio FROM pairs JOIN ({PERMUTED}) x ON a = x.unit JOIN ({PERMUTED}) y ON b = y.unit AND x.rep = y.rep GROUP BY x.rep"
register("r9_permutation_p", permuted_p, f"SELECT observed, avg((ratio <= observed)::INT) AS p, quantile_cont(ratio, 0.05) AS p05, quantile_cont(ratio, 0.95) AS p95, stddev_samp(ratio) AS null_sd FROM ({NULL_RATIOS}), (SELECT round(within / between_, 9) AS observed FROM ({WITHIN})) GROUP BY 1", "pairs", "observed p p05 p95 null_sd")


def anchor_permutation(s, d):
    """For each dimension the observed correlation with the anchors, and where it stands among deals of the anchors' units."""
    base = bridge(s, d)
    rhos = R.permuted_correlations(base, ["dimension"], "composite", "z", ANCHOR_DEALS).select("dimension", F.round("rho", 9).alias("rho"))
    observed = T.spearman(base, ["dimension"], "composite", "z").select("dimension", F.round("rho", 9).alias("observed"))
    stood = rhos.join(observed, "dimension").groupBy("dimension", "observed").agg(*R.permutation_summary("rho", F.col("observed"), less=False))
    return stood.withColumn("beyond_chance", F.col("p") <= 0.05)


def rank_permutation(s, d):
    """The median rank of units for their own adapters, and where it stands among those of units dealt to the adapters."""
    rows = G.policy_unit_tvd(X.aligned(s, d)).where("policy <> 'base'").select("policy", F.col("unit").alias("other"), F.round("d", 9).alias("d"))
    rows = written(rows, "unit-distances")
    ranks = S.ranks(rows, ["policy"], "d", ["other"]).select(F.regexp_replace("policy", "_adapter$", "").alias("unit"), "other", F.col("rank_by_count").alias("rank"))
    # Only units that have an adapter can be dealt, so that each deal is one of the same units.
    units = written(ranks.select("unit").distinct(), "units")
    ranks = ranks.join(units.withColumnRenamed("unit", "other"), "other")
    null = R.permuted_medians(ranks, ANCHOR_DEALS)
    observed = ranks.where("unit = other").agg(F.percentile("rank", 0.5).alias("observed"))
    return null.crossJoin(F.broadcast(observed)).groupBy("observed").agg(*R.permutation_summary("median", F.col("observed")), F.percentile("median", 0.5).alias("null_median")).withColumn("beyond_chance", F.col("p") <= 0.05)


AVG = lambda x, by: f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0"
register(
    "r10_anchor_permutation",
    anchor_permutation,
    f"""SELECT dimension, observed, avg((rho >= observed)::INT) AS p, quantile_cont(rho, 0.05) AS p05, quantile_cont(rho, 0.95) AS p95, stddev_samp(rho) AS null_sd, avg((rho >= observed)::INT) <= 0.05 AS beyond_chance FROM (SELECT dimension, rep, round(corr(rx, ry), 9) AS rho FROM (SELECT dimension, rep, {AVG('composite', 'dimension, rep')} AS rx, {AVG('z', 'dimension, rep')} AS ry FROM
    (SELECT t.dimension, rep, t.composite, o.z FROM (SELECT rep, unit, row_number() OVER (PARTITION BY rep ORDER BY md5('perm|' || rep || '|' || unit), unit) AS i FROM (SELECT DISTINCT unit FROM ({BRIDGE})), generate_series(1, {ANCHOR_DEALS}) r(rep)) u
    JOIN (SELECT unit AS other, row_number() OVER (ORDER BY unit) AS i FROM (SELECT DISTINCT unit FROM ({BRIDGE}))) v USING (i) JOIN ({BRIDGE}) t ON t.unit = u.unit JOIN ({BRIDGE}) o ON o.unit = v.other AND o.dimension = t.dimension)) GROUP BY 1, 2)
    JOIN (SELECT dimension, round(corr(rx, ry), 9) AS observed FROM ({RANKED}) GROUP BY 1) USING (dimension) GROUP BY 1, 2""",
    "means anchors",
    "observed p p05 p95 null_sd",
)
ADAPTED = "SELECT replace(policy, '_adapter', '') AS unit, unit AS other, rank() OVER (PARTITION BY policy ORDER BY round(d, 9)) AS r FROM (SELECT policy, unit, avg(tvd) AS d FROM evaluated WHERE policy <> 'base' GROUP BY 1, 2)"
register(
    "r10_rank_permutation",
    rank_permutation,
    f"""SELECT observed, avg((m <= observed)::INT) AS p, quantile_cont(m, 0.05) AS p05, quantile_cont(m, 0.95) AS p95, stddev_samp(m) AS null_sd, quantile_cont(m, 0.5) AS null_median, avg((m <= observed)::INT) <= 0.05 AS beyond_chance FROM (SELECT rep, quantile_cont(r, 0.5) AS m FROM (SELECT rep, unit, row_number() OVER (PARTITION BY rep ORDER BY md5('perm|' || rep || '|' || unit), unit) AS i
    FROM (SELECT DISTINCT unit FROM ({ADAPTED})), generate_series(1, {ANCHOR_DEALS}) g(rep)) u JOIN (SELECT unit AS other, row_number() OVER (ORDER BY unit) AS i FROM (SELECT DISTINCT unit FROM ({ADAPTED}))) o USING (i) JOIN ({ADAPTED}) a ON a.unit = u.unit AND a.other = o.other GROUP BY rep), (SELECT quantile_cont(r, 0.5) AS observed FROM ({ADAPTED}) WHERE unit = other) GROUP BY observed""",
    "evaluated",
    "observed p p05 p95 null_sd null_median",
)

def gradients(s, d):
    """Each unit's discounts, and all units' together, on a flag, an amount, its square and the tax: four covariates."""
    q = F.col("l_quantity") / 50
    rows = X.lines(s, d).select("unit", F.when(F.col("I4") == 1, 1.0).otherwise(0.0).alias("flag"), q.alias("amount"), (q * q).alias("amount2"), (F.col("l_tax") * 10).alias("tax"), "l_discount")
    out = T.least_squares(rows, ["unit"], ["flag", "amount", "amount2", "tax"], "l_discount", pooled=True)
    return out.select(F.when(F.col("pooled"), "pooled").otherwise(F.col("unit")).alias("spec"), "term", "b", "se", "n")


def gradients_sql() -> str:
    """The same by inverting the covariances in columns, one pivot after the other."""
    xs = {"flag": "CASE WHEN I4 = 1 THEN 1.0::DOUBLE ELSE 0.0 END", "amount": "l_quantity / 50", "amount2": "l_quantity / 50 * l_quantity / 50", "tax": "l_tax * 10"}
    p, at = range(len(xs)), [*xs.values(), "l_discount"]
    sums = [f"n * covar_pop({at[i]}, {at[j]}) AS s{i}{j}" for i in p for j in [*p, 4]] + [f"{int(i == j)}.0::DOUBLE AS v{i}{j}" for i in p for j in p]
    body = f"SELECT coalesce(unit, 'pooled') AS spec, count(*) AS n, {', '.join(f'avg({c}) AS m{k}' for k, c in enumerate(at))}, n * var_pop(l_discount) AS yy, {', '.join(sums)} FROM lines GROUP BY GROUPING SETS ((unit), ())"
    body = body.replace("n * ", "count(*) * ")
    cells = [f"s{{i}}{j}" for j in [*p, 4]] + [f"v{{i}}{j}" for j in p]
    for k in p:
        new = [f"{c.format(i=i)} / s{k}{k} AS {c.format(i=i)}" if i == k else f"{c.format(i=i)} - s{i}{k} / s{k}{k} * {c.format(i=k)} AS {c.format(i=i)}" for i in p for c in cells]
        body = f"SELECT spec, n, yy, {', '.join(f'm{i}' for i in range(5))}, {', '.join(f'c{i}' if k else f's{i}4 AS c{i}' for i in p)}, {', '.join(new)} FROM ({body})"
    rss = "yy - " + " - ".join(f"s{i}4 * c{i}" for i in p)
    level = "m4 - " + " - ".join(f"s{i}4 * m{i}" for i in p)
    spread = "1.0 / n + " + " + ".join(f"m{i} * v{i}{j} * m{j}" for i in p for j in p)
    b = " ".join(f"WHEN '{x}' THEN s{k}4" for k, x in enumerate(xs))
    v = " ".join(f"WHEN '{x}' THEN v{k}{k}" for k, x in enumerate(xs))
    return f"SELECT spec, term, CASE term {b} ELSE {level} END AS b, sqrt(greatest(0, {rss}) / (n - 5) * CASE term {v} ELSE {spread} END) AS se, n FROM ({body}), (VALUES ('const'), {', '.join(f"('{x}')" for x in xs)}) t(term)"


register("r11_least_squares", gradients, gradients_sql(), "lines", "b se")
register("r12_r13_agreement", lambda s, d: X.anchors(s, d).select("unit", "dimension", T.benchmark_agreement(F.col("z") * 3, F.when(F.col("unit") < "N20", F.lit(1))).alias("agrees"), (F.col("z") * -1 >= 0.2).alias("ordered")), "SELECT unit, dimension, CASE WHEN unit < 'N20' THEN sign(z) = 1 AND abs(z * 3) > 1.96 END AS agrees, z * -1 >= 0.2 AS ordered FROM anchors", "anchors")
register("r14_median_rank", lambda s, d: G.own_unit_rank(G.policy_unit_tvd(X.aligned(s, d)).where("policy <> 'base'").withColumn("d", F.round("d", 12)), F.col("policy") == F.concat("unit", F.lit("_adapter"))).agg(F.percentile("own_rank", 0.5).alias("median_rank"), F.max((F.col("n") + 1) / 2).alias("chance")), "SELECT quantile_cont(r, 0.5) AS median_rank, max((n + 1) / 2) AS chance FROM (SELECT policy, unit, rank() OVER (PARTITION BY policy ORDER BY d) AS r, count(*) OVER (PARTITION BY policy) AS n FROM (SELECT policy, unit, round(avg(tvd), 12) AS d FROM evaluated WHERE policy <> 'base' GROUP BY 1, 2)) WHERE policy = unit || '_adapter'", "evaluated", "median_rank chance")

# Further views of the same tables
register("a38_value_counts", lambda s, d: X.answers(s, d).groupBy("item", "value").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order")), "SELECT item, value, count(*) AS n, min(l_orderkey) AS first_order FROM answers GROUP BY 1, 2", "answers", "value")
register(
    "a43_reference_margin",
    lambda s, d: baseline(s, d).where("relationship = 'matched'").groupBy("unit").agg(F.avg("tvd").alias("tvd"), F.avg("base_tvd").alias("base_tvd"), F.avg(F.col("base_jsd") - F.col("jsd")).alias("jsd_gain"), F.avg((F.col("base_tvd") > F.col("tvd")).cast("double")).alias("improved"), F.count("*").alias("n")),
    f"SELECT unit, avg(tvd) AS tvd, avg(base_tvd) AS base_tvd, avg(base_jsd - jsd) AS jsd_gain, avg((base_tvd > tvd)::INT) AS improved, count(*) AS n FROM ({CANDIDATES}) WHERE relationship = 'matched' GROUP BY 1",
    "evaluated",
    "tvd base_tvd jsd_gain improved",
)
register(
    "b9_policy_comparison",
    lambda s, d: X.evaluated(s, d).groupBy("unit").pivot("relationship", ["base", "matched"]).agg(F.avg("tvd")).where("matched is not null").select("unit", "base", "matched", (F.col("base") - F.col("matched")).alias("difference"), (F.col("matched") < F.col("base")).alias("wins")),
    "SELECT unit, base, matched, base - matched AS difference, matched < base AS wins FROM (SELECT unit, avg(tvd) FILTER (relationship = 'base') AS base, avg(tvd) FILTER (relationship = 'matched') AS matched FROM evaluated GROUP BY 1) WHERE matched IS NOT NULL",
    "evaluated",
    "base matched difference",
)
register(
    "d6_strong_pairs",
    lambda s, d: G.euclidean_pairs(X.anchors(s, d).withColumn("z", F.round("z", 9)), least=3).where("passes").select("a", "b", F.round("d", 4).alias("d"), "n_strong"),
    "SELECT a, b, round(d, 4) AS d, n AS n_strong FROM (SELECT x.unit AS a, y.unit AS b, sqrt(sum((round(x.z, 9) - round(y.z, 9)) * (round(x.z, 9) - round(y.z, 9)))) AS d, count(*) FILTER (abs(round(x.z, 9) - round(y.z, 9)) > 0.3) AS n FROM anchors x JOIN anchors y USING (dimension) WHERE x.unit < y.unit GROUP BY 1, 2) WHERE n >= 3",
    "anchors",
    "d",
)


def plane_ranks(s, d):
    """Of each adapter the rank of its own unit among all units, in the plane of the principal axes and by total variation, with both distances."""
    sums = X.sums(s, d)
    at = principal_axes(s, d, sums)
    own = F.col("policy") == F.concat("unit", F.lit("_adapter"))
    policies = at.where("name like '%_adapter'").select(F.col("name").alias("policy"), F.col("x1").alias("p1"), F.col("x2").alias("p2"))
    # Populations squared, never rows of data.
    far = policies.crossJoin(F.broadcast(at.where("name not like '%_adapter' and name <> 'base'").select(F.col("name").alias("unit"), "x1", "x2")))
    plane = far.select("policy", "unit", F.round(F.sqrt(F.pow(F.col("p1") - F.col("x1"), 2) + F.pow(F.col("p2") - F.col("x2"), 2)), 9).alias("d"))
    by_tvd = G.own_unit_rank(G.policy_unit_tvd(X.aligned(s, d, sums)).where("policy <> 'base'").withColumn("d", F.round("d", 9)), own)
    return G.own_unit_rank(plane, own).select("policy", F.col("own_rank").alias("plane_rank"), F.col("own_d").alias("plane_d")).join(by_tvd.select("policy", F.col("own_rank").alias("tvd_rank"), F.col("own_d").alias("tvd_d")), "policy")


register(
    "d11_plane_ranks",
    plane_ranks,
    f"""WITH RECURSIVE {PLANE} SELECT policy, plane_rank, plane_d, tvd_rank, tvd_d FROM (SELECT policy, max(r) FILTER (policy = unit || '_adapter') AS plane_rank, max(d) FILTER (policy = unit || '_adapter') AS plane_d FROM (SELECT *, rank() OVER (PARTITION BY policy ORDER BY d) AS r FROM (SELECT p.name AS policy, u.name AS unit, round(sqrt(pow(p.x1 - u.x1, 2) + pow(p.x2 - u.x2, 2)), 9) AS d FROM placed p JOIN placed u ON p.name LIKE '%_adapter' AND u.name NOT LIKE '%_adapter' AND u.name <> 'base')) GROUP BY 1)
    JOIN (SELECT policy, max(r) FILTER (policy = unit || '_adapter') AS tvd_rank, max(d) FILTER (policy = unit || '_adapter') AS tvd_d FROM (SELECT *, rank() OVER (PARTITION BY policy ORDER BY d) AS r FROM (SELECT policy, unit, round(avg(tvd), 9) AS d FROM evaluated WHERE policy <> 'base' GROUP BY 1, 2)) GROUP BY 1) USING (policy) WHERE plane_d IS NOT NULL AND tvd_d IS NOT NULL""",
    "means policies evaluated",
    "plane_d tvd_d",
)
