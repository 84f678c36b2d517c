"""Queries of scans, recodes, distributions and metrics."""

from __future__ import annotations

import warnings

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import distributions as D
from ..operators import metrics as M
from ..operators import quality as K
from ..operators import summaries as S
from ..sources import files
from ..sources.shared import scratch, written
from . import fixtures as X
from .registry import register

NOT_ORDERED = "('I4', 'I5')"

# Scans and recodes
register("s1_columnar_scan", lambda s, d: files.columnar(s, f"{d}/lineitem.parquet", ["l_returnflag", "l_quantity"]).where("l_quantity >= 40").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("amount")), "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS amount FROM lineitem WHERE l_quantity >= 40 GROUP BY 1", doubles="amount")


def family_counts(s, d):
    """Customers and suppliers, whose columns differ, as families of one table; a third family isn't there."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows = files.families(s, {"buyers": f"{d}/customer.parquet", "sellers": f"{d}/supplier.parquet", "agents": f"{d}/agents-*.parquet"})
    counts = rows.groupBy("bank", "file").agg(F.count("*").alias("n"), F.count("c_mktsegment").alias("segments"), F.count("s_suppkey").alias("suppliers"))
    return counts.withColumn("missing", F.lit(",".join(rows.missing)))


register("s5_family_tag", family_counts, "SELECT 'buyers' AS bank, 'customer.parquet' AS file, count(*) AS n, count(c_mktsegment) AS segments, 0 AS suppliers, 'agents' AS missing FROM customer UNION ALL SELECT 'sellers', 'supplier.parquet', count(*), 0, count(s_suppkey), 'agents' FROM supplier", ints="segments suppliers")


def waves(s, d):
    first = X.table(s, d, "customer").select(F.col("c_custkey").alias("Key"), F.col("c_acctbal").alias("Balance"), F.col("c_mktsegment").alias("Segment"))
    second = X.table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return files.waves([first, second], ["key", "balance", "segment"]).groupBy("segment").agg(F.count("*").alias("n"), F.avg("balance").alias("balance"))


register("s6_union_of_waves", waves, "SELECT segment, count(*) AS n, avg(balance) AS balance FROM (SELECT c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_acctbal, NULL FROM supplier) GROUP BY segment", doubles="balance")
register("s10_ordered_columns", lambda s, d: files.ordered_columns(X.table(s, d, "nation"), ["n_name"]), "SELECT n_name, * EXCLUDE (n_name) FROM nation", ints="n_nationkey n_regionkey")
register("s11_manifest", lambda s, d: files.manifest(X.missing(s, d).withColumn("valid", C.mask_missing(F.col("value"))), "unit", ["valid", "weight"]), "SELECT unit, count(*) AS n, avg(CASE WHEN value >= 0 THEN 1.0 ELSE 0 END) AS share_valid, avg(CASE WHEN weight IS NOT NULL THEN 1.0 ELSE 0 END) AS share_weight FROM missing GROUP BY unit", "missing", "share_valid share_weight")


def vectors_file(s, d):
    """The anchors (one row a unit and dimension) written as a JSON file of one object, and read again."""
    path = scratch(s, "vectors")
    units = X.anchors(s, d).groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "z"))).alias("m"))
    whole = units.agg(F.map_from_entries(F.collect_list(F.struct("unit", "m"))).alias("all"))
    whole.select(F.to_json("all", {"pretty": "true"})).write.text(path)
    return files.map_of_maps(s, path)


register("s4_map_of_maps", vectors_file, "SELECT unit, dimension, z FROM anchors", "anchors", "z")


def mapped(s, d):
    spec = X.answers(s, d).select("item", F.bround("value").cast("int").cast("string").alias("c")).distinct().groupBy("item").agg(F.array_join(F.sort_array(F.collect_list("c")), " ; ").alias("codes"))
    codes = C.split_field(F.col("codes"))
    labels = C.align_labels(codes, C.split_field(F.lit("low; nan; ; high")))
    return spec.select("item", F.size(codes).alias("n_codes"), F.array_join(labels, "|").alias("labels"))


register(
    "p1_p2_codes_and_labels",
    mapped,
    """SELECT item, count(*) AS n_codes, string_agg(CASE k WHEN 1 THEN 'low' WHEN 3 THEN 'high' ELSE c END, '|' ORDER BY k) AS labels FROM
    (SELECT item, c, row_number() OVER (PARTITION BY item ORDER BY c) AS k FROM (SELECT DISTINCT item, CAST(CAST(value AS INTEGER) AS VARCHAR) AS c FROM answers)) GROUP BY item""",
    "answers",
)
register("p3_canonical_code", lambda s, d: X.table(s, d, "part").select("p_partkey", C.canonical_code(F.col("p_size") / 2).alias("code")), "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS code FROM part")
register("p4_observed_support", lambda s, d: D.observed_support(X.answers(s, d), 0, 60), "SELECT DISTINCT item, value FROM answers WHERE value BETWEEN 0 AND 60", "answers", "value")


def grid(s, d):
    spec = s.createDataFrame([("I4", ["1", "2", "3", "4"], ["a", "n", "r"]), ("I5", ["2", "1"], ["open", "final", "extra"]), ("I7", ["1", "2", "3", "4", "5", "6"], [])], "item string, codes array<string>, labels array<string>")
    return D.option_grid(spec)


register(
    "p5_a1_grid_distribution",
    lambda s, d: D.grid_distribution(X.missing(s, d), ["unit"], grid(s, d)).select("unit", "item", "option_index", "code", "label", "n", "weight", "prob", "n_valid", "total_weight"),
    """SELECT unit, g.item, option_index, code, label, coalesce(n, 0) AS n, coalesce(w, 0) AS weight, coalesce(w, 0) / sum(coalesce(w, 0)) OVER (PARTITION BY unit, g.item) AS prob, sum(coalesce(n, 0)) OVER (PARTITION BY unit, g.item) AS n_valid, sum(coalesce(w, 0)) OVER (PARTITION BY unit, g.item) AS total_weight
    FROM (VALUES ('I4',0,'1','a'),('I4',1,'2','n'),('I4',2,'3','r'),('I4',3,'4','4'),('I5',0,'2','open'),('I5',1,'1','final'),('I7',0,'1','1'),('I7',1,'2','2'),('I7',2,'3','3'),('I7',3,'4','4'),('I7',4,'5','5'),('I7',5,'6','6')) g(item, option_index, code, label)
    CROSS JOIN (SELECT DISTINCT unit FROM missing) LEFT JOIN (SELECT unit, item, value, count(*) AS n, sum(weight) AS w FROM missing WHERE weight > 0 AND value >= 0 GROUP BY ALL) a USING (unit, item) WHERE FALSE
    UNION ALL SELECT u.unit, g.item, option_index, code, label, coalesce(n, 0), coalesce(w, 0), coalesce(w, 0) / sum(coalesce(w, 0)) OVER (PARTITION BY u.unit, g.item), sum(coalesce(n, 0)) OVER (PARTITION BY u.unit, g.item), sum(coalesce(w, 0)) OVER (PARTITION BY u.unit, g.item)
    FROM (VALUES ('I4',0,'1','a'),('I4',1,'2','n'),('I4',2,'3','r'),('I4',3,'4','4'),('I5',0,'2','open'),('I5',1,'1','final'),('I7',0,'1','1'),('I7',1,'2','2'),('I7',2,'3','3'),('I7',3,'4','4'),('I7',4,'5','5'),('I7',5,'6','6')) g(item, option_index, code, label)
    CROSS JOIN (SELECT DISTINCT unit FROM missing) u LEFT JOIN (SELECT unit, item, CAST(CAST(value AS INTEGER) AS VARCHAR) AS code, count(*) AS n, sum(weight) AS w FROM missing WHERE weight > 0 AND value >= 0 GROUP BY ALL) a USING (unit, item, code)""",
    "missing",
    "weight prob total_weight",
    "option_index n n_valid",
)
register("p6_clean_weight", lambda s, d: X.missing(s, d).groupBy("item").agg(F.count(C.clean_weight(F.col("weight") - 10)).alias("n"), F.sum(C.clean_weight(F.col("weight") - 10)).alias("total")), "SELECT item, count(*) FILTER (weight > 10) AS n, sum(weight - 10) FILTER (weight > 10) AS total FROM missing GROUP BY item", "missing", "total")
register(
    "p7_missing_modes",
    lambda s, d: X.missing(s, d).groupBy("item").agg(*(F.count(C.mask_missing(F.col("value"), m)).alias(m) for m in ("negative", "minus1_5", "miss_set"))),
    "SELECT item, count(*) FILTER (value >= 0) AS negative, count(*) FILTER (value NOT IN (-1,-2,-3,-4,-5)) AS minus1_5, count(*) FILTER (value NOT IN (-1,-2,-3,-4,-5,88,98,888888,988888,999999)) AS miss_set FROM missing GROUP BY item",
    "missing",
)
KIND = X.sql_lookup("item", X.KINDS)
RECODED = f"CASE {KIND} WHEN 'invert4' THEN 5 - value WHEN 'invert10' THEN 11 - value WHEN 'binary' THEN CASE WHEN value = 1 THEN 1.0 ELSE 0.0 END ELSE value END"
register("p8_polarity", lambda s, d: X.answers(s, d).groupBy("item").agg(F.avg(C.recode(F.col("value"), X.lookup(F.col("item"), X.KINDS))).alias("mean")), f"SELECT item, avg({RECODED}) AS mean FROM answers GROUP BY item", "answers", "mean")


def orders_of_recoding(s, d):
    kind = X.lookup(F.col("item"), X.KINDS)
    mean = F.avg("value")
    rows = X.answers(s, d).groupBy("unit", "item").agg(F.avg(C.recode(F.col("value"), kind)).alias("by_value"), mean.alias("m"))
    return rows.select("unit", "item", "by_value", C.recode_mean(F.col("m"), kind).alias("mean_equal"), C.recode_mean(F.col("m"), kind, "threshold").alias("mean_threshold"))


register(
    "p9_recode_orders",
    orders_of_recoding,
    f"""SELECT unit, item, by_value, CASE {KIND} WHEN 'binary' THEN CASE WHEN m = 1 THEN 1.0 ELSE 0.0 END WHEN 'invert4' THEN 5 - m WHEN 'invert10' THEN 11 - m ELSE m END AS mean_equal,
    CASE {KIND} WHEN 'binary' THEN CASE WHEN m < 1.5 THEN 1.0 ELSE 0.0 END WHEN 'invert4' THEN 5 - m WHEN 'invert10' THEN 11 - m ELSE m END AS mean_threshold
    FROM (SELECT unit, item, avg({RECODED}) AS by_value, avg(value) AS m FROM answers GROUP BY unit, item)""",
    "answers",
    "by_value mean_equal mean_threshold",
)
register(
    "p10_item_subset",
    lambda s, d: X.answers(s, d).join(F.broadcast(s.createDataFrame([("I6",), ("I2",)], "item string")), "item", "left_anti").groupBy("item").agg(F.count("*").alias("n")),
    "SELECT item, count(*) AS n FROM answers WHERE item NOT IN ('I6', 'I2') GROUP BY item",
    "answers",
)


def scales(s, d):
    n = X.answers(s, d).groupBy("item").agg(F.count_distinct("value").alias("n"))
    scale = C.scale_class(F.when(F.col("item") == "I1", "multi5").otherwise("single"), F.col("n"), ~F.col("item").isin(X.UNORDERED))
    return n.select("item", "n", scale.alias("scale"), C.scale_family(scale).alias("family"))


register(
    "p11_scale_class",
    scales,
    f"""SELECT item, n, scale, CASE scale WHEN 'binary_yn' THEN 'binary' WHEN 'multiple_response_max5' THEN 'multi_select' WHEN 'other_numeric' THEN 'other' ELSE 'ordered' END AS family FROM
    (SELECT item, n, CASE WHEN n > 12 THEN 'other_numeric' WHEN item = 'I1' THEN 'multiple_response_max5' WHEN n = 2 THEN 'binary_yn' WHEN item NOT IN {NOT_ORDERED} THEN 'ordered_' || n || 'pt' ELSE 'single_choice_' || n END AS scale FROM (SELECT item, count(DISTINCT value) AS n FROM answers GROUP BY item))""",
    "answers",
)
register("p12_p13_names", lambda s, d: X.evaluated(s, d).groupBy("policy").agg(F.count_if(F.col("relationship") == "matched").alias("matched"), F.count_if(F.col("relationship") == "cross").alias("cross"), F.max(C.unit_name(F.col("policy"))).alias("name")), "SELECT policy, count(*) FILTER (relationship = 'matched') AS matched, count(*) FILTER (relationship = 'cross') AS cross, CASE WHEN policy = 'base' THEN 'BASE' ELSE substr(policy, 1, 3) END AS name FROM evaluated GROUP BY policy", "evaluated")
register(
    "p14_p17_magnitude",
    lambda s, d: X.anchors(s, d).select("unit", "dimension", C.magnitude(F.col("z")).alias("magnitude"), C.near_zero(F.col("z")).alias("near"), C.trait_level(F.col("z")).alias("level"), C.rounded_level(F.col("z")).alias("rounded"), C.clip(F.col("z")).alias("clipped")),
    """SELECT unit, dimension, CASE WHEN abs(z) < 0.1 THEN 'near_zero' ELSE CASE WHEN abs(z) < 0.4 THEN 'moderate_' ELSE 'strong_' END || CASE WHEN z >= 0 THEN 'positive' ELSE 'negative' END END AS magnitude, abs(z) < 0.1 AS near,
    CASE WHEN z < -0.66 THEN -3 WHEN z < -0.33 THEN -2 WHEN z < 0 THEN -1 WHEN z < 0.33 THEN 1 WHEN z < 0.66 THEN 2 ELSE 3 END AS level, round_even(z * 3, 0) AS rounded, greatest(0, least(1, z)) AS clipped FROM anchors""",
    "anchors",
    "clipped",
    "level rounded",
)
register("p16_contamination_class", lambda s, d: X.bank(s, d).groupBy(C.contamination_class(F.col("m_a")).alias("class")).agg(F.count("*").alias("n")), "SELECT CASE WHEN m_a < 0.3 THEN 'low' WHEN m_a < 0.7 THEN 'medium' ELSE 'high' END AS class, count(*) AS n FROM bank GROUP BY 1", "bank")
register("p18_rename", lambda s, d: X.anchors(s, d).select("unit", F.coalesce(X.lookup(F.col("dimension"), {"risk": "risk_taking", "amount": "quantity"}), "dimension").alias("dimension"), "z"), "SELECT unit, CASE dimension WHEN 'risk' THEN 'risk_taking' WHEN 'amount' THEN 'quantity' ELSE dimension END AS dimension, z FROM anchors", "anchors", "z")
register("p20_p21_unpivot_pivot", lambda s, d: X.means(s, d).groupBy("unit").pivot("item", list(X.ITEMS)).agg(F.first("mean")), "SELECT unit, " + ", ".join(f"max(mean) FILTER (item = '{i}') AS {i}" for i in X.ITEMS) + " FROM means GROUP BY unit", "means", " ".join(X.ITEMS))

# Joins and distributions
register(
    "j1_many_to_one",
    lambda s, d: K.many_to_one(X.table(s, d, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal"), X.table(s, d, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), ["k"]).groupBy("n_name").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total")),
    "SELECT n_name, count(*) AS n, sum(c_acctbal) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    doubles="total",
)
register(
    "j10_semi_anti",
    lambda s, d: X.table(s, d, "part").join(X.table(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").join(X.table(s, d, "lineitem").where("l_discount > 0.05").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_brand"),
    "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.05)",
)
register("j5_j8_aligned", lambda s, d: X.aligned(s, d).groupBy("policy", "unit").agg(F.count("*").alias("n"), F.sum("p").alias("p"), F.sum(F.col("q") * F.col("q")).alias("qq")), "SELECT policy, unit, count(*) AS n, sum(p) AS p, sum(q * q) AS qq FROM aligned GROUP BY 1, 2", "aligned", "p qq")
register(
    "j6_union_grid",
    lambda s, d: D.union_grid(X.people(s, d).where("value <= 5"), X.people(s, d).where("value >= 2"), ["unit", "item"]).groupBy("unit", "item").agg((0.5 * F.sum(F.abs(F.col("p") - F.col("q")))).alias("tvd"), F.count("*").alias("n")),
    """SELECT unit, item, 0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))) AS tvd, count(*) AS n FROM (SELECT unit, item, value, p / sum(p) OVER (PARTITION BY unit, item) AS p, q / sum(q) OVER (PARTITION BY unit, item) AS q FROM
    (SELECT unit, item, value, CASE WHEN value <= 5 THEN prob END AS p, CASE WHEN value >= 2 THEN prob END AS q FROM people)) GROUP BY unit, item""",
    "people",
    "tvd",
)
register("j12_fallback", lambda s, d: X.evaluated(s, d).where("relationship = 'matched'").select("unit", "item", F.col("tvd").alias("own")).join(X.evaluated(s, d).where("policy = 'base'").select("unit", "item", F.col("tvd").alias("base")), ["unit", "item"], "right").select("unit", "item", F.coalesce("own", "base").alias("tvd")), "SELECT b.unit, b.item, coalesce(m.tvd, b.tvd) AS tvd FROM (SELECT * FROM evaluated WHERE policy = 'base') b LEFT JOIN (SELECT * FROM evaluated WHERE relationship = 'matched') m USING (unit, item)", "evaluated", "tvd")
register("a2_distribution", lambda s, d: D.distribution(X.missing(s, d), ["unit"], least=50).select("unit", "item", "value", "n", "weight", "prob", "n_valid"), "SELECT * FROM (SELECT unit, item, value, count(*) AS n, sum(weight) AS weight, sum(weight) / sum(sum(weight)) OVER w AS prob, sum(count(*)) OVER w AS n_valid FROM missing WHERE value >= 0 AND weight > 0 GROUP BY unit, item, value WINDOW w AS (PARTITION BY unit, item)) WHERE n_valid >= 50", "missing", "value weight prob", "n_valid")
register(
    "a3_softmax",
    lambda s, d: D.softmax(X.policies(s, d).withColumns({"score": F.ln("prob") * 2, "tokens": (F.col("value") % 3 + 1).cast("int")}), ["policy", "item"], temperature=1.5, length="tokens").select("policy", "item", "value", "prob"),
    "SELECT policy, item, value, e / sum(e) OVER (PARTITION BY policy, item) AS prob FROM (SELECT policy, item, value, exp(ln(prob) * 2 / (value % 3 + 1) / 1.5) AS e FROM policies)",
    "policies",
    "value prob",
)
register(
    "a12_item_metrics",
    lambda s, d: X.evaluated(s, d).select("policy", "unit", "item", "n_options", "tvd", "jsd", "brier", "cross_entropy", "entropy_error", "mean_error", "abs_mean_error", "std_error", "wasserstein", "top_match", "relationship", "dimension"),
    "SELECT policy, unit, item, n_options, tvd, jsd, brier, cross_entropy, entropy_error, mean_error, abs_mean_error, std_error, wasserstein, top_match, relationship, dimension FROM evaluated",
    "evaluated",
    "tvd jsd brier cross_entropy entropy_error mean_error abs_mean_error std_error wasserstein",
)
register(
    "a5_jsd_conventions",
    lambda s, d: X.aligned(s, d).groupBy("policy", "unit", "item").agg(M.jensen_shannon("2", 1e-12).alias("jsd2"), M.jensen_shannon().alias("jsd")),
    """SELECT policy, unit, item, 0.5 * sum(a * log2(a / ((a + b) / 2)) + b * log2(b / ((a + b) / 2))) AS jsd2, 0.5 * sum(a * ln(a / ((a + b) / 2)) + b * ln(b / ((a + b) / 2))) AS jsd FROM (SELECT *, greatest(p, 1e-12) AS a, greatest(q, 1e-12) AS b FROM aligned) GROUP BY 1, 2, 3""",
    "aligned",
    "jsd2 jsd",
)
#: Aligned shares to 12 digits, so that the order of sums can't put one beside another edge or digit.
NEAR = "(SELECT policy, round(q, 12) AS q, round(p, 12) AS p FROM aligned)"


def near(rows):
    return rows.withColumns({"q": F.round("q", 12), "p": F.round("p", 12)})


#: Sums of whole numbers of 10^-12.
MEAN = "CAST(sum(CAST(round({0} * 1e12) AS HUGEINT)) AS DOUBLE) / count(*) / 1e12"
EDGE = "(" + " + ".join(f"(q > {k}/10.0)::INT" for k in range(1, 10)) + ")"
register("a22_calibration_bins", lambda s, d: M.calibration_bins(near(X.aligned(s, d)), ["policy"]), f"SELECT policy, {EDGE} AS bin, {MEAN.format('q')} AS mean_predicted, {MEAN.format('p')} AS mean_observed, count(*) AS n FROM {NEAR} GROUP BY 1, 2", "aligned", "mean_predicted mean_observed", "bin")
register("a22_calibration_error", lambda s, d: M.calibration_error(M.calibration_bins(near(X.aligned(s, d)), ["policy"]), ["policy"]), f"SELECT policy, sum(n * abs(a - b)) / sum(n) AS ece, sum(n) AS n FROM (SELECT policy, {EDGE} AS bin, {MEAN.format('q')} AS a, {MEAN.format('p')} AS b, count(*) AS n FROM {NEAR} GROUP BY 1, 2) GROUP BY 1", "aligned", "ece", "n")

# Transforms
register("b1_uniform", lambda s, d: D.uniform(X.people(s, d).select("unit", "item", "value"), ["unit", "item"]), "SELECT unit, item, value, 1.0 / count(*) OVER (PARTITION BY unit, item) AS prob FROM people", "people", "value prob")


def sweep(s, d):
    rows = D.temperature_sweep(X.aligned(s, d).withColumnRenamed("q", "prob"), ["policy", "unit", "item"], [1, 1.25, 1.5, 2, 3], F.col("item") == "I1")
    items = rows.groupBy("policy", "unit", "item", "temperature").agg((0.5 * F.sum(F.abs(F.col("p") - F.col("prob")))).alias("tvd"), (-F.sum(F.col("prob") * F.ln("prob")) + F.sum(F.col("p") * F.ln("p"))).alias("entropy_error"))
    return items


SWEEP = """SELECT policy, unit, item, temperature, 0.5 * sum(abs(p - prob)) AS tvd, -sum(prob * ln(prob)) + sum(p * ln(p)) AS entropy_error FROM (SELECT *, e / sum(e) OVER (PARTITION BY policy, unit, item, temperature) AS prob FROM
    (SELECT a.*, t.temperature, pow(q, 1 / CASE WHEN item = 'I1' THEN 1.0 ELSE t.temperature END) AS e FROM aligned a, (VALUES (1.0::DOUBLE), (1.25), (1.5), (2.0), (3.0)) t(temperature))) GROUP BY 1, 2, 3, 4"""
register("b2_temperature_sweep", lambda s, d: sweep(s, d).groupBy("policy", "temperature").agg(F.avg("tvd").alias("tvd"), F.count("*").alias("n")), f"SELECT policy, temperature, avg(tvd) AS tvd, count(*) AS n FROM ({SWEEP}) GROUP BY 1, 2", "aligned", "temperature tvd")
register("b3_best_temperature", lambda s, d: sweep(s, d).groupBy("item", "temperature").agg(F.avg("entropy_error").alias("e")).groupBy("item").agg(F.min_by("temperature", F.struct(F.round(F.abs("e"), 9).alias("e"), "temperature")).alias("temperature")), f"SELECT item, arg_min(temperature, struct_pack(e := round(abs(e), 9), t := temperature)) AS temperature FROM (SELECT item, temperature, avg(entropy_error) AS e FROM ({SWEEP}) GROUP BY 1, 2) GROUP BY 1", "aligned", "temperature")


def entropy_grid(s, d):
    over = W.partitionBy("unit", "item")
    grid = X.people(s, d).where(~F.col("item").isin(X.UNORDERED)).select("unit", "item", "value")
    z = X.anchors(s, d).where("dimension = 'trust'").select("unit", "z")
    return grid.join(F.broadcast(z), "unit").withColumn("mean", F.greatest(F.min("value").over(over), F.least(F.max("value").over(over), F.avg("value").over(over) + 0.5 * F.col("z"))))


def bent(grid):
    """Fitted probabilities with the slope of their logarithms from the option before; null where a bound on the mean leaves options without mass."""
    rows = D.max_entropy(grid, ["unit", "item"], "value", "mean").join(grid, ["unit", "item", "value"])
    over = W.partitionBy("unit", "item").orderBy("value")
    inside = (F.col("mean") > F.min("value").over(W.partitionBy("unit", "item"))) & (F.col("mean") < F.max("value").over(W.partitionBy("unit", "item")))
    return rows.withColumn("slope", F.when(inside, (F.ln("prob") - F.lag(F.ln("prob")).over(over)) / (F.col("value") - F.lag("value").over(over))))


register(
    "b4_max_entropy",
    lambda s, d: bent(entropy_grid(s, d)).groupBy("unit", "item").agg(F.sum(F.col("prob") * F.col("value")).alias("mean"), F.sum("prob").alias("total"), (F.max("slope") - F.min("slope")).alias("bend"), F.count("*").alias("n")),
    # Of all distributions with the mean, the one of the greatest entropy is that whose log probabilities lie on a line: no bend.
    "SELECT unit, item, least(max(value), greatest(min(value), avg(value) + 0.5 * max(z))) AS mean, 1.0 AS total, CASE WHEN avg(value) + 0.5 * max(z) > min(value) AND avg(value) + 0.5 * max(z) < max(value) THEN 0.0 END AS bend, count(*) AS n FROM people JOIN anchors USING (unit) WHERE dimension = 'trust' AND item NOT IN ('I4', 'I5') GROUP BY 1, 2",
    "people anchors",
    "mean total bend",
)
register(
    "b5_sign_follower",
    lambda s, d: D.sign_follower(X.people(s, d).select("unit", "item", "value").join(X.anchors(s, d).where("dimension = 'risk'"), "unit"), ["unit", "item"], "value", "z").select("unit", "item", "value", "prob"),
    "SELECT unit, item, value, CASE WHEN value = CASE WHEN z >= 0 THEN max(value) OVER w ELSE min(value) OVER w END THEN 1.0 ELSE 0.0 END AS prob FROM people JOIN anchors USING (unit) WHERE dimension = 'risk' WINDOW w AS (PARTITION BY unit, item)",
    "people anchors",
    "value prob",
)
register("b7_collapse", lambda s, d: D.collapsed(X.people(s, d).select("unit", "item", (F.col("value") % 3).alias("value"), "prob"), ["unit", "item", "value"]), "SELECT unit, item, value % 3 AS value, sum(prob) AS prob FROM people GROUP BY 1, 2, 3", "people", "value prob")
CELLS = "SELECT CASE WHEN policy = 'base' THEN 'base' ELSE 'tuned' END AS weights, CASE WHEN relationship = 'matched' THEN 'own' ELSE 'other' END AS prompt, unit, tvd, top_match::INT AS top_match FROM evaluated"
WANTED = "SELECT weights, prompt, unit FROM (SELECT DISTINCT unit FROM people), (VALUES ('base', 'other'), ('tuned', 'own'), ('tuned', 'other')) v(weights, prompt)"


def cells(s, d):
    """Each evaluation in its cell of weights and prompt, and the cells that every unit must have."""
    rows = X.evaluated(s, d).select(F.when(F.col("policy") == "base", "base").otherwise("tuned").alias("weights"), F.when(F.col("relationship") == "matched", "own").otherwise("other").alias("prompt"), "unit", "tvd", F.col("top_match").cast("double").alias("top_match"))
    kinds = s.createDataFrame([("base", "other"), ("tuned", "own"), ("tuned", "other")], "weights string, prompt string")
    return rows, X.people(s, d).select("unit").distinct().crossJoin(F.broadcast(kinds))


def two_by_two(s, d):
    rows, wanted = cells(s, d)
    table = rows.groupBy("weights", "prompt").agg(F.avg("tvd").alias("tvd"), F.avg("top_match").alias("top_match"), F.count_distinct("unit").alias("units"))
    return K.complete_only(table, K.missing_cells(rows, ["weights", "prompt", "unit"], wanted))


def lacking(s, d):
    rows, wanted = cells(s, d)
    return K.missing_cells(rows.where("prompt <> 'own' or unit >= 'N03'"), ["weights", "prompt", "unit"], wanted)


register("b8_two_by_two", two_by_two, f"SELECT weights, prompt, avg(tvd) AS tvd, avg(top_match) AS top_match, count(DISTINCT unit) AS units FROM ({CELLS}) WHERE NOT EXISTS ({WANTED} EXCEPT SELECT weights, prompt, unit FROM ({CELLS})) GROUP BY 1, 2", "evaluated people", "tvd top_match")
register("b8_missing_cells", lacking, f"{WANTED} EXCEPT SELECT weights, prompt, unit FROM ({CELLS}) WHERE prompt <> 'own' OR unit >= 'N03'", "evaluated people")


def banks(s, d):
    clean = {w: C.clean_weight(F.col(w)) for w in ("weight", "price", "one")}
    rows = X.answers(s, d).withColumn("one", F.lit(1.0)).groupBy("unit", "item", "value").agg(*(F.sum(c).alias(w) for w, c in clean.items()), *(F.count(c).alias(f"n_{w}") for w, c in clean.items()))
    # Lines are summed up once; the three banks are made of the sums.
    rows = written(rows, "bank-sums")
    out = None
    for k, w in enumerate(["weight", "price", "one"]):
        part = D.distribution(rows.select("unit", "item", "value", F.col(w).alias("weight"), F.col(f"n_{w}").alias("k")), ["unit"], count="k").where(F.substring("unit", 3, 1).cast("int") % 3 >= k).select("unit", "item", "value", "prob", F.lit(w).alias("bank"))
        out = part if out is None else out.unionByName(part)
    return out


register(
    "w1_bank_precedence",
    lambda s, d: D.precedence(banks(s, d), ["unit", "item", "value"], X.lookup(F.col("bank"), {"one": "0", "price": "1", "weight": "2"}), ["bank"]),
    """SELECT unit, item, value, CASE k WHEN 2 THEN o WHEN 1 THEN c ELSE prob END AS prob, CASE k WHEN 2 THEN 'one' WHEN 1 THEN 'price' ELSE 'weight' END AS bank FROM (SELECT unit, item, value, CAST(substr(unit, 3, 1) AS INTEGER) % 3 AS k,
    sum(weight) / sum(sum(weight)) OVER w AS prob, sum(price) / sum(sum(price)) OVER w AS c, count(*) / sum(count(*)) OVER w AS o FROM answers GROUP BY 1, 2, 3 WINDOW w AS (PARTITION BY unit, item))""",
    "answers",
    "value prob",
)


def drifting(s, d):
    """Waves with differing columns, all of them kept; position is the column's place in the union."""
    first = X.table(s, d, "customer").select(F.col("c_nationkey").alias("Nation"), F.col("c_acctbal").alias("Balance"), F.col("c_mktsegment").alias("Segment"))
    second = X.table(s, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    rows = files.waves([first, second])
    return files.column_report(rows, rows.columns).select("column", "n", X.lookup(F.col("column"), {c: str(k) for k, c in enumerate(rows.columns)}).alias("position"))


register("u5_union_of_columns", drifting, "SELECT 'nation' AS column, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n, '0' AS position UNION ALL SELECT 'balance', (SELECT count(c_acctbal) FROM customer) + (SELECT count(s_acctbal) FROM supplier), '1' UNION ALL SELECT 'segment', count(c_mktsegment), '2' FROM customer UNION ALL SELECT 'name', count(s_name), '3' FROM supplier")
register("s7_required_columns", lambda s, d: files.column_report(X.table(s, d, "documents"), ["doc_id", "lang", "text", "rating"]), "SELECT 'doc_id' AS column, TRUE AS present, count(doc_id) AS n FROM documents UNION ALL SELECT 'lang', TRUE, count(lang) FROM documents UNION ALL SELECT 'text', TRUE, count(text) FROM documents UNION ALL SELECT 'rating', FALSE, NULL")
register("u1_u4_sets", lambda s, d: X.table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(X.table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))).union(X.table(s, d, "nation").select(F.col("n_nationkey").alias("k"))).distinct().exceptAll(X.table(s, d, "region").select(F.col("r_regionkey").alias("k"))), "SELECT n_nationkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region", ints="k")
register("a31_coverage", lambda s, d: S.coverage(X.missing(s, d), ["item"], "miss_set"), "SELECT item, avg(CASE WHEN value NOT IN (-1,-2,-3,-4,-5,88,98,888888,988888,999999) THEN 1.0 ELSE 0 END) AS share, count(*) FILTER (value NOT IN (-1,-2,-3,-4,-5,88,98,888888,988888,999999)) AS n_valid, count(*) AS n FROM missing GROUP BY item", "missing", "share")
