"""Views over the driver's tables that the registered queries work on, each as a DataFrame and as SQL.

Units are the customers' nations and policies the suppliers'. Answers are order lines, unpivoted to items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import distributions as D
from ..sources.shared import written

ITEMS = {"I1": "number", "I2": "discount", "I3": "tax", "I4": "flag", "I5": "status", "I6": "quantity", "I7": "priority"}
DIMENSIONS = {"I1": "trust", "I2": "risk", "I3": "risk", "I4": "patience", "I5": "trust", "I6": "patience", "I7": "trust"}
KINDS = {"I1": "none", "I2": "invert10", "I3": "none", "I4": "invert4", "I5": "binary", "I6": "none", "I7": "none"}
CLASSES = {"I1": "near", "I2": "far", "I3": "far", "I4": "near", "I5": "near", "I6": "far", "I7": "near"}
UNORDERED = ["I4", "I5"]


def lookup(item, table: dict[str, str]):
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[item]


def sql_lookup(item: str, table: dict[str, str]) -> str:
    return f"CASE {item} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order line: unit, policy, the items and what weights and anchors need. Only these columns are read."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    flag = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0).otherwise(3.0)
    status = F.when(F.col("l_linestatus") == "F", 1.0).otherwise(2.0)
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", flag.alias("I4"), status.alias("I5"))
    # As N%02d, from functions that are quick on every line.
    name = lambda c: F.concat(F.lit("N"), F.when(F.col(c).between(0, 9), F.lit("0")).otherwise(F.lit("")), F.col(c).cast("string"))
    # Orders find their nation first, and lines theirs: so lines are shuffled once, to their orders, and customers only meet orders.
    orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")
    items = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).drop("l_suppkey", "s_suppkey")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        name("c_nationkey").alias("unit"),
        name("s_nationkey").alias("source"),
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "o_totalprice",
        "o_orderdate",
        F.col("l_linenumber").cast("double").alias("I1"),
        F.round(F.col("l_discount") * 100).alias("I2"),
        F.round(F.col("l_tax") * 100).alias("I3"),
        "I4",
        "I5",
        F.round("l_quantity").alias("I6"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("I7"),
    )


SQL = {
    "lines": """SELECT printf('N%02d', c_nationkey) AS unit, printf('N%02d', s_nationkey) AS source, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, o_totalprice, o_orderdate,
    CAST(l_linenumber AS DOUBLE) AS I1, round(l_discount * 100) AS I2, round(l_tax * 100) AS I3, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 ELSE 3.0 END::DOUBLE AS I4,
    CASE l_linestatus WHEN 'F' THEN 1.0 ELSE 2.0 END::DOUBLE AS I5, round(l_quantity) AS I6, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS I7
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""",
    "answers": "SELECT unit, source, l_quantity AS weight, l_extendedprice AS price, l_orderkey, l_linenumber, item, value FROM lines UNPIVOT (value FOR item IN (I1, I2, I3, I4, I5, I6, I7))",
    "missing": "SELECT unit, item, CASE WHEN item = 'I2' AND value = 10 THEN -1.0 WHEN item = 'I3' AND value = 8 THEN -2.0 WHEN item = 'I6' AND value = 50 THEN 99.0 WHEN item = 'I6' AND value = 49 THEN 98.0 ELSE value END AS value, CASE WHEN l_linenumber = 7 THEN NULL ELSE weight END AS weight FROM answers",
    "people": "SELECT unit, item, value, count(*) AS n, sum(weight) AS weight, sum(weight) / sum(sum(weight)) OVER (PARTITION BY unit, item) AS prob, sum(count(*)) OVER (PARTITION BY unit, item) AS n_valid FROM answers GROUP BY unit, item, value",
    "policies": """SELECT source || '_adapter' AS policy, item, value, sum(price) / sum(sum(price)) OVER (PARTITION BY source, item) AS prob FROM answers GROUP BY source, item, value
    UNION ALL SELECT 'base' AS policy, item, value, count(*) / sum(count(*)) OVER (PARTITION BY item) AS prob FROM answers GROUP BY item, value""",
    "aligned": """SELECT policy, unit, item, value, q / sum(q) OVER w AS q, p / sum(p) OVER w AS p FROM (SELECT q.policy, p.unit, p.item, p.value, q.prob AS q, p.prob AS p, count(*) OVER (PARTITION BY q.policy, p.unit, p.item) AS k
    FROM policies q JOIN people p ON q.item = p.item AND q.value = p.value) WHERE k >= 2 WINDOW w AS (PARTITION BY policy, unit, item)""",
    "stepped": "SELECT *, abs(sum(p - q) OVER (PARTITION BY policy, unit, item ORDER BY value ROWS UNBOUNDED PRECEDING)) * (lead(value) OVER (PARTITION BY policy, unit, item ORDER BY value) - value) AS w FROM aligned",
    "metrics": """SELECT policy, unit, item, count(*) AS n_options, 0.5 * sum(abs(p - q)) AS tvd,
    0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) AS jsd,
    sum((p - q) * (p - q)) AS brier, -sum(p * ln(greatest(least(q, 1.0), 1e-12))) AS cross_entropy, -sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS entropy_error,
    sum(p * value) AS mean_p, sum(q * value) AS mean_q, sqrt(greatest(0, sum(p * value * value) - sum(p * value) * sum(p * value))) AS std_p, sqrt(greatest(0, sum(q * value * value) - sum(q * value) * sum(q * value))) AS std_q,
    coalesce(sum(w), 0) AS wasserstein, arg_max(value, struct_pack(a := p, b := -value)) AS mode_p, arg_max(value, struct_pack(a := q, b := -value)) AS mode_q FROM stepped GROUP BY policy, unit, item""",
    "evaluated": f"""SELECT policy, unit, item, n_options, tvd, jsd, brier, cross_entropy, entropy_error, item NOT IN ('I4', 'I5') AS is_ordered, CASE WHEN item NOT IN ('I4', 'I5') THEN mean_p END AS mean_p, CASE WHEN item NOT IN ('I4', 'I5') THEN mean_q END AS mean_q,
    CASE WHEN item NOT IN ('I4', 'I5') THEN mean_q - mean_p END AS mean_error, CASE WHEN item NOT IN ('I4', 'I5') THEN abs(mean_q - mean_p) END AS abs_mean_error, CASE WHEN item NOT IN ('I4', 'I5') THEN std_q - std_p END AS std_error,
    CASE WHEN item NOT IN ('I4', 'I5') THEN wasserstein END AS wasserstein, mode_p = mode_q AS top_match, {sql_lookup("item", DIMENSIONS)} AS dimension, {sql_lookup("item", CLASSES)} AS class,
    CASE WHEN policy = 'base' THEN 'base' WHEN policy = unit || '_adapter' THEN 'matched' ELSE 'cross' END AS relationship FROM metrics""",
    "raw_anchors": """SELECT unit, dimension, x FROM (SELECT unit, avg(l_quantity) AS amount, avg(l_discount) AS patience, avg(l_tax) AS risk, avg(o_totalprice) AS trust FROM lines GROUP BY unit) UNPIVOT (x FOR dimension IN (amount, patience, risk, trust))""",
    "anchors": "SELECT unit, dimension, (x - avg(x) OVER (PARTITION BY dimension)) / stddev_pop(x) OVER (PARTITION BY dimension) AS z FROM raw_anchors",
    "moments": "SELECT unit, item, sum(prob * value) AS mean, sum(prob * value * value) AS mean_square, string_agg(CAST(value AS VARCHAR), ',' ORDER BY value) AS grid FROM people GROUP BY unit, item",
    "pairs": """SELECT a, b, avg(CASE WHEN t <= 1e-12 THEN 0 ELSE g / t END) AS d, count(*) AS n_items FROM (SELECT x.unit AS a, y.unit AS b, ((x.mean - y.mean) / 2) * ((x.mean - y.mean) / 2) AS g,
    (x.mean_square + y.mean_square) / 2 - ((x.mean + y.mean) / 2) * ((x.mean + y.mean) / 2) AS t FROM moments x JOIN moments y ON x.item = y.item AND x.unit < y.unit AND x.grid = y.grid) GROUP BY a, b""",
    "means": "SELECT unit, item, sum(value * weight) / sum(weight) AS mean, count(*) AS n FROM answers GROUP BY unit, item",
    "bank_rows": """SELECT p_partkey, ['trust','risk','patience','amount'][CAST(p_partkey % 4 AS INTEGER) + 1] AS dimension, p_name || ' ' || p_type || ' ' || CAST(p_partkey AS VARCHAR) AS prompt, p_brand AS response_a, p_type AS response_b,
    CAST(p_partkey * 3 % 101 AS DOUBLE) / 100 AS m_a, CAST(p_size * 7 % 101 AS DOUBLE) / 100 AS m_b, 0 AS seq FROM part
    UNION ALL SELECT p_partkey, ['trust','risk','patience','amount'][CAST(p_partkey % 4 AS INTEGER) + 1], p_name || ' ' || p_type || ' ' || CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 50 = 0 THEN 'other' ELSE p_brand END, p_type,
    CAST(p_partkey * 3 % 101 AS DOUBLE) / 100, CAST(p_size * 7 % 101 AS DOUBLE) / 100, 1 FROM part WHERE p_partkey % 10 = 0""",
    "bank": """SELECT dimension, prompt, p_partkey, arg_min(response_a, seq) AS response_a, arg_min(response_b, seq) AS response_b, arg_min(m_a, seq) AS m_a, arg_min(m_b, seq) AS m_b, count(*) AS copies, count(DISTINCT (response_a, response_b)) AS versions FROM bank_rows GROUP BY dimension, prompt, p_partkey""",
    "labelled": """SELECT unit, b.dimension, prompt, p_partkey, z, CASE WHEN z >= 0 THEN 'A' ELSE 'B' END AS chosen_option, CASE WHEN z >= 0 THEN response_a ELSE response_b END AS chosen, CASE WHEN z >= 0 THEN response_b ELSE response_a END AS rejected,
    CASE WHEN z >= 0 THEN m_a ELSE m_b END AS m_chosen, CASE WHEN z >= 0 THEN m_b ELSE m_a END AS m_rejected, abs(z) < 0.10 AS near_zero_z FROM bank b JOIN anchors a ON a.dimension = b.dimension""",
    "gated": """SELECT *, CASE WHEN s IS NULL THEN 'score_fail' WHEN NOT s * CASE WHEN z < 0 THEN -1 ELSE 1 END > -0.03 THEN 'mono_fail' WHEN NOT abs(s) >= 0.20 THEN 'dist_fail' ELSE 'pass' END AS qc_status FROM (SELECT *, m_chosen - m_rejected AS s FROM
    (SELECT * REPLACE (CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE m_chosen END AS m_chosen) FROM labelled))""",
    "rewards": """SELECT unit, dimension, prompt, p_partkey, chosen, rejected, -CAST((p_partkey * 7 + ascii(substr(unit, 3, 1))) % 97 AS DOUBLE) / 10 AS chosen_logp, -CAST((p_partkey * 11 + ascii(substr(unit, 2, 1))) % 89 AS DOUBLE) / 10 AS rejected_logp,
    -CAST(p_partkey * 5 % 83 AS DOUBLE) / 10 AS ref_chosen_logp, -CAST(p_partkey * 13 % 79 AS DOUBLE) / 10 AS ref_rejected_logp FROM labelled""",
}


def sql(body: str, *names: str) -> str:
    """body with the views it names (and those that they need) before it."""
    needed: list[str] = []

    def add(name: str) -> None:
        if name not in needed:
            for other in SQL:
                if other != name and f" {other} " in SQL[name].replace("\n", " ").replace("(", " ").replace(")", " ").replace(",", " ") + " ":
                    add(other)
            needed.append(name)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in needed) + " " + body if needed else body


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, source, weight, price, l_orderkey, l_linenumber, item, value."""
    wide = lines(spark, sf_dir).withColumns({"weight": F.col("l_quantity"), "price": F.col("l_extendedprice")})
    return D.long_answers(wide, ["unit", "source", "weight", "price", "l_orderkey", "l_linenumber"], list(ITEMS))


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answers with missing codes and weights."""
    v, i = F.col("value"), F.col("item")
    code = F.when((i == "I2") & (v == 10), -1.0).when((i == "I3") & (v == 8), -2.0).when((i == "I6") & (v == 50), 99.0).when((i == "I6") & (v == 49), 98.0).otherwise(v)
    return answers(spark, sf_dir).select("unit", "item", code.alias("value"), F.when(F.col("l_linenumber") != 7, F.col("weight")).alias("weight"))


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit, source, item, value and sums over their answers; clean and n_clean over weights that count. Written, for plans of several jobs: its size doesn't depend on the lines, which are read and shuffled once."""
    return written(_sums(answers(spark, sf_dir)), "sums")


def _sums(rows: DataFrame) -> DataFrame:
    clean = C.clean_weight(F.col("weight"))
    return rows.groupBy("unit", "source", "item", "value").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum("price").alias("price"), F.sum(clean).alias("clean"), F.count(clean).alias("n_clean"))


def tallies(spark: SparkSession, sf_dir: str, sums: DataFrame | None = None) -> DataFrame:
    """kind, key, item, value, n, weight: what people and policies are sums of.

    Answers are added up once by unit, source, item and value. Each of these sums is then three rows: of its unit's people,
    of its source's adapter and of base. Plans that take several of them share the one aggregation (Spark reuses its shuffle).
    """
    sums = _sums(answers(spark, sf_dir)) if sums is None else sums
    of = lambda kind, key, weight: F.struct(F.lit(kind).alias("kind"), key.alias("key"), weight.alias("weight"))
    kinds = F.array(of("people", F.col("unit"), F.col("weight")), of("policy", F.concat("source", F.lit("_adapter")), F.col("price")), of("policy", F.lit("base"), F.col("n").cast("double")))
    return sums.select("item", "value", "n", F.explode(kinds).alias("of")).select("of.kind", "of.key", "item", "value", "n", "of.weight")


def people(spark: SparkSession, sf_dir: str, sums: DataFrame | None = None) -> DataFrame:
    rows = tallies(spark, sf_dir, sums).where("kind = 'people'").withColumnRenamed("key", "unit")
    return D.distribution(rows, ["unit"], count="n")


def policies(spark: SparkSession, sf_dir: str, sums: DataFrame | None = None) -> DataFrame:
    """policy, item, value, prob: an adapter for each source (weighted by price), and base (unweighted)."""
    rows = tallies(spark, sf_dir, sums).where("kind = 'policy'").withColumnRenamed("key", "policy")
    return D.distribution(rows, ["policy"], count="n").select("policy", "item", "value", "prob")


def aligned(spark: SparkSession, sf_dir: str, sums: DataFrame | None = None) -> DataFrame:
    return D.joined(policies(spark, sf_dir, sums), people(spark, sf_dir, sums))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item metrics of every policy on every unit, with dimension, class and relationship."""
    from ..operators.metrics import item_metrics

    rows = item_metrics(aligned(spark, sf_dir), ["policy", "unit", "item"], ~F.col("item").isin(UNORDERED))
    return rows.withColumns({"is_ordered": ~F.col("item").isin(UNORDERED), "dimension": lookup(F.col("item"), DIMENSIONS), "class": lookup(F.col("item"), CLASSES), "relationship": C.relationship(F.col("policy"), F.col("unit"))})


def raw_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = lines(spark, sf_dir).groupBy("unit").agg(F.avg("l_quantity").alias("amount"), F.avg("l_discount").alias("patience"), F.avg("l_tax").alias("risk"), F.avg("o_totalprice").alias("trust"))
    return means.unpivot("unit", ["amount", "patience", "risk", "trust"], "dimension", "x")


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.distances import z_scores

    return z_scores(raw_anchors(spark, sf_dir)).select("unit", "dimension", "z")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.distances import cell_moments

    return cell_moments(people(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.distances import item_pairs, population_distance

    return population_distance(item_pairs(moments(spark, sf_dir)))


def means(spark: SparkSession, sf_dir: str, sums: DataFrame | None = None) -> DataFrame:
    from ..operators.summaries import weighted_mean

    if sums is not None:
        return weighted_mean(sums, ["unit", "item"], weight="clean", count="n_clean")
    return weighted_mean(answers(spark, sf_dir), ["unit", "item"])


def bank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.element_at(F.array(*(F.lit(d) for d in ("trust", "risk", "patience", "amount"))), (key % 4 + 1).cast("int")).alias("dimension"),
        F.concat_ws(" ", "p_name", "p_type", key.cast("string")).alias("prompt"),
        F.col("p_brand").alias("response_a"),
        F.col("p_type").alias("response_b"),
        (key * 3 % 101 / 100).alias("m_a"),
        (F.col("p_size") * 7 % 101 / 100).alias("m_b"),
        F.lit(0).alias("seq"),
    )
    again = part.where(key % 10 == 0).withColumns({"response_a": F.when(key % 50 == 0, "other").otherwise(F.col("response_a")), "seq": F.lit(1)})
    return part.union(again)


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pairs import bank as build

    return build(bank_rows(spark, sf_dir), ["dimension", "prompt", "p_partkey"], ["seq"])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pairs import label_pairs

    return label_pairs(bank(spark, sf_dir), anchors(spark, sf_dir))


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.pairs import quality_gates

    rows = labelled(spark, sf_dir).withColumn("m_chosen", F.when(F.col("p_partkey") % 17 != 0, F.col("m_chosen")))
    return quality_gates(rows)


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    letter = lambda k: F.ascii(F.substring("unit", k, 1))
    return labelled(spark, sf_dir).select(
        "unit",
        "dimension",
        "prompt",
        "p_partkey",
        "chosen",
        "rejected",
        (-((key * 7 + letter(3)) % 97) / 10).alias("chosen_logp"),
        (-((key * 11 + letter(2)) % 89) / 10).alias("rejected_logp"),
        (-(key * 5 % 83) / 10).alias("ref_chosen_logp"),
        (-(key * 13 % 79) / 10).alias("ref_rejected_logp"),
    )
