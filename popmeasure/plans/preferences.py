"""Queries of preference pairs, contracts, text jobs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import pairs as P
from ..operators import quality as K
from ..sources import files
from ..sources.shared import scratch
from ..streaming import jobs
from . import fixtures as X
from .registry import register

DIMS = ["amount", "patience", "risk", "trust"]


# Banks and labels
register("q1_content_key", lambda s, d: X.bank(s, d).select("p_partkey", C.content_key(F.col("dimension"), F.col("prompt")).alias("key"), F.substring(F.sha2(F.to_json(F.struct("dimension", "prompt")), 256), 1, 16).alias("cache_key")), """SELECT p_partkey, substr(sha1(dimension || chr(10) || prompt), 1, 12) AS key, substr(sha256('{"dimension":"' || dimension || '","prompt":"' || prompt || '"}'), 1, 16) AS cache_key FROM bank""", "bank")
register("q2_bank", lambda s, d: X.bank(s, d).drop("seq"), "SELECT * FROM bank", "bank", "m_a m_b")
register("q2_conflicts", lambda s, d: P.flagged_conflicts(X.bank(s, d)).select("dimension", "p_partkey", "copies", "versions", "conflict"), "SELECT dimension, p_partkey, copies, versions, versions > 1 AS conflict FROM bank", "bank")


def rotated(s, d):
    rows = X.labelled(s, d).select("unit", "p_partkey", F.when(F.col("p_partkey") % 13 != 0, F.col("chosen_option")).alias("chosen_option"), F.col("m_chosen").alias("m_chosen_x"), F.col("m_rejected").alias("m_rejected_x"))
    return P.rotate_scores(rows, ["x"]).select("unit", "p_partkey", "m_a_x", "m_b_x")


register("q3_rotation", rotated, "SELECT unit, p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN m_a END AS m_a_x, CASE WHEN p_partkey % 13 <> 0 THEN m_b END AS m_b_x FROM labelled JOIN bank USING (dimension, prompt, p_partkey)", "labelled bank", "m_a_x m_b_x")
register("j9_q4_labels", lambda s, d: X.labelled(s, d).select("unit", "dimension", "p_partkey", "z", "chosen_option", "chosen", "rejected", "m_chosen", "m_rejected", "near_zero_z"), "SELECT unit, dimension, p_partkey, z, chosen_option, chosen, rejected, m_chosen, m_rejected, near_zero_z FROM labelled", "labelled", "z m_chosen m_rejected")
register("q5_label_manifest", lambda s, d: X.labelled(s, d).groupBy("unit").agg(F.count("*").alias("n"), F.count_if("near_zero_z").alias("near"), F.array_join(F.sort_array(F.collect_set(F.concat("dimension", F.when(F.col("z") >= 0, "+").otherwise("-")))), ",").alias("signs")), "SELECT unit, count(*) AS n, count(*) FILTER (near_zero_z) AS near, string_agg(DISTINCT dimension || CASE WHEN z >= 0 THEN '+' ELSE '-' END, ',' ORDER BY dimension || CASE WHEN z >= 0 THEN '+' ELSE '-' END) AS signs FROM labelled GROUP BY 1", "labelled")
register("q6_health", lambda s, d: P.health(X.bank(s, d).withColumn("m_a", F.when(F.col("p_partkey") % 9 != 0, F.col("m_a")))), "SELECT sum(copies) AS rows, count(*) AS keys, 0 AS missing, count(*) FILTER (versions > 1) AS conflicts, count(*) FILTER (p_partkey % 9 <> 0 AND m_a > m_b) AS polarity_ok, count(*) FILTER (p_partkey % 9 <> 0 AND m_a < m_b) AS polarity_inverted, count(*) FILTER (p_partkey % 9 = 0) AS unscored, count(*) FILTER (versions > 1) = 0 AS ok FROM bank", "bank", ints="rows missing")
register("q7_gates", lambda s, d: X.gated(s, d).select("unit", "p_partkey", F.col("signed").alias("s"), "qc_status"), "SELECT unit, p_partkey, s, qc_status FROM gated", "gated", "s")
register("a33_a35_status_counts", lambda s, d: P.status_counts(X.gated(s, d)), "SELECT dimension, count(*) FILTER (qc_status = 'score_fail') AS score_fail, count(*) FILTER (qc_status = 'mono_fail') AS mono_fail, count(*) FILTER (qc_status = 'dist_fail') AS dist_fail, count(*) FILTER (qc_status = 'pass') AS pass, count(*) AS n FROM gated GROUP BY ROLLUP (dimension)", "gated")


def ratios(s, d):
    scores = lambda a, b: F.create_map(*(x for k, dim in enumerate(DIMS) for x in (F.lit(dim), (F.col("p_partkey") * (k + a) % b / 100))))
    ratio = P.contamination(scores(3, 101), scores(7, 89), F.lit("risk"))
    return X.bank(s, d).select("p_partkey", ratio.alias("ratio"), C.contamination_class(ratio).alias("class"))


GAP = lambda k: f"abs(CAST(p_partkey * {k + 3} % 101 AS DOUBLE) / 100 - CAST(p_partkey * {k + 7} % 89 AS DOUBLE) / 100)"
register("q8_contamination", ratios, f"SELECT p_partkey, r AS ratio, CASE WHEN r < 0.3 THEN 'low' WHEN r < 0.7 THEN 'medium' WHEN r >= 0.7 THEN 'high' END AS class FROM (SELECT p_partkey, CASE WHEN {GAP(2)} > 0 THEN round((0.0 + {GAP(0)} + {GAP(1)} + {GAP(3)}) / {GAP(2)}, 4) END AS r FROM bank)", "bank", "ratio")
register(
    "a34_qc_manifest",
    lambda s, d: X.gated(s, d).agg(F.round(F.avg((F.col("qc_status") == "pass").cast("double")), 4).alias("pass_rate"), F.round(F.avg(F.col("mono_pass").cast("double")), 4).alias("mono_rate"), F.round(F.avg(F.col("dist_pass").cast("double")), 4).alias("dist_rate"), F.count("*").alias("n")),
    "SELECT round(avg((qc_status = 'pass')::INT), 4) AS pass_rate, round(avg(coalesce(s * CASE WHEN z < 0 THEN -1 ELSE 1 END > -0.03, FALSE)::INT), 4) AS mono_rate, round(avg(coalesce(abs(s) >= 0.20, FALSE)::INT), 4) AS dist_rate, count(*) AS n FROM gated",
    "gated",
    "pass_rate mono_rate dist_rate",
)
register("a36_group_mean_map", lambda s, d: X.anchors(s, d).groupBy("dimension").agg(F.avg("z").alias("z")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", F.round("z", 6) + F.lit(0.0))))).alias("m")).select(F.array_join(F.map_keys("m"), ",").alias("dimensions"), F.size("m").alias("n")), "SELECT string_agg(DISTINCT dimension, ',' ORDER BY dimension) AS dimensions, count(DISTINCT dimension) AS n FROM anchors", "anchors")
register("a37_pair_order", lambda s, d: X.labelled(s, d).groupBy("prompt").agg(P.same_pair().alias("same"), F.count("*").alias("n")), "SELECT prompt, count(DISTINCT least(chosen, rejected) || '|' || greatest(chosen, rejected)) = 1 AS same, count(*) AS n FROM labelled GROUP BY 1", "labelled")


def levels(s, d):
    docs = X.table(s, d, "documents").select("doc_id", "n_chars")
    return docs.select((F.floor(F.col("doc_id") / 7) % 5).cast("long").alias("scenario"), F.floor(F.col("doc_id") / 35).cast("long").alias("block"), F.element_at(F.array(*(F.lit(x) for x in (-3, -2, -1, 1, 2, 3, 3))), (F.col("doc_id") % 7 + 1).cast("int")).alias("level"), F.col("doc_id").alias("seq"), F.concat(F.lit("text "), F.col("doc_id").cast("string")).alias("text"))


LEVELS = "SELECT doc_id // 7 % 5 AS scenario, doc_id // 35 AS block, [-3,-2,-1,1,2,3,3][CAST(doc_id % 7 AS INTEGER) + 1] AS level, doc_id, 'text ' || doc_id AS text FROM documents"
LAST = f"SELECT scenario, block, level, arg_max(text, doc_id) AS text FROM ({LEVELS}) GROUP BY 1, 2, 3"
BUILT = f"""SELECT scenario, block, CASE WHEN swap THEN tl ELSE th END AS response_a, CASE WHEN swap THEN th ELSE tl END AS response_b, CASE WHEN swap THEN low ELSE high END AS level_a, CASE WHEN swap THEN high ELSE low END AS level_b FROM
    (SELECT h.scenario, h.block, h.text AS th, l.text AS tl, v.high, v.low, ('0x' || substr(md5('order|' || h.scenario || '|' || h.block || '|' || v.high || '|' || v.low), 1, 8))::BIGINT % 2 = 1 AS swap
    FROM (VALUES (-3, 3), (-1, 1), (3, 2), (-3, -2), (1, 2), (-1, -2)) v(high, low) JOIN ({LAST}) h ON h.level = v.high JOIN ({LAST}) l ON l.level = v.low AND l.scenario = h.scenario AND l.block = h.block)"""
register("q9_level_pairs", lambda s, d: P.level_pairs(levels(s, d), ["scenario", "block"]), BUILT, ints="level_a level_b")


def chosen(s, d):
    rows = P.level_pairs(levels(s, d), ["scenario", "block"])
    target = (F.col("block") % 7 - 3).cast("int")
    both = rows.withColumns({"chosen_option": P.nearest_choice(target, F.col("level_a"), F.col("level_b")), "plain": P.nearest_choice(target, F.col("level_a"), F.col("level_b"), conservative=False)})
    return P.materialised(both).select("scenario", "block", "chosen_option", "plain", "chosen", "rejected", "chosen_level", "rejected_level")


PLAIN = "CASE WHEN abs(level_a - t) < abs(level_b - t) THEN 'A' WHEN abs(level_b - t) < abs(level_a - t) THEN 'B'"
register(
    "q10_q11_nearest_choice",
    chosen,
    f"""SELECT scenario, block, c AS chosen_option, plain, CASE c WHEN 'A' THEN response_a ELSE response_b END AS chosen, CASE c WHEN 'A' THEN response_b ELSE response_a END AS rejected, CASE c WHEN 'A' THEN level_a ELSE level_b END AS chosen_level, CASE c WHEN 'A' THEN level_b ELSE level_a END AS rejected_level
    FROM (SELECT *, {PLAIN} WHEN abs(level_a) >= abs(level_b) THEN 'A' ELSE 'B' END AS c, {PLAIN} ELSE 'tie' END AS plain FROM (SELECT *, block % 7 - 3 AS t FROM ({BUILT})))""",
    ints="chosen_level rejected_level",
)
DRAW = lambda key: f"('0x' || substr(md5('split|' || {key}), 1, 8))::BIGINT"
register("q12_split_by_prompt", lambda s, d: P.split_by_prompt(X.labelled(s, d).select("unit", "prompt"), "prompt"), f"SELECT unit, prompt, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM labelled JOIN (SELECT prompt, row_number() OVER (ORDER BY {DRAW('prompt')}, prompt) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT prompt FROM labelled)) USING (prompt)", "labelled")
register("q12_split_rows", lambda s, d: P.split_rows(X.labelled(s, d).select("unit", "p_partkey"), ["unit"], "p_partkey"), f"SELECT unit, p_partkey, CASE WHEN row_number() OVER (PARTITION BY unit ORDER BY {DRAW('p_partkey')}, p_partkey) <= floor(count(*) OVER (PARTITION BY unit) * 0.8) THEN 'train' ELSE 'test' END AS part FROM labelled", "labelled")
register("q13_validation", lambda s, d: P.validation(X.labelled(s, d).withColumn("chosen", F.when(F.col("p_partkey") % 31 != 0, F.col("chosen")).otherwise(" "))), "SELECT count(*) AS n, count(*) FILTER (p_partkey % 31 = 0) AS empty_text, 0 AS same_answers, 0 AS repeated_prompts, count(*) FILTER (p_partkey % 31 = 0) = 0 AS ok FROM labelled", "labelled", ints="same_answers repeated_prompts")
register("q14_prompts", lambda s, d: X.bank(s, d).select("p_partkey", C.starts_with_context(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" context: "), "prompt")).otherwise(F.col("prompt"))).alias("prompt")), "SELECT p_partkey, 'Context: ' || prompt AS prompt FROM bank", "bank")


def cache(s, d) -> DataFrame:
    return P.reference_cache(X.rewards(s, d))


CACHE = "SELECT prompt, completion, min(logp) AS logp, max(logp) - min(logp) > 1e-5 AS conflict FROM (SELECT prompt, chosen AS completion, ref_chosen_logp AS logp FROM rewards UNION ALL SELECT prompt, rejected, ref_rejected_logp FROM rewards) GROUP BY 1, 2"
register("q15_reference_cache", cache, CACHE, "rewards", "logp")
register("j11_q16_coverage", lambda s, d: P.with_reference(X.rewards(s, d).select("unit", "prompt", "chosen", "rejected"), cache(s, d).where("completion not like 'STANDARD%'")).groupBy("unit").agg(F.count("ref_chosen").alias("have_chosen"), F.count("ref_rejected").alias("have_rejected"), F.count("*").alias("n")), "SELECT unit, count(*) FILTER (chosen NOT LIKE 'STANDARD%') AS have_chosen, count(*) FILTER (rejected NOT LIKE 'STANDARD%') AS have_rejected, count(*) AS n FROM rewards GROUP BY 1", "rewards")
register("q16_missing_keys", lambda s, d: P.missing_keys(X.rewards(s, d), X.bank(s, d).where("p_partkey % 4 <> 0"), ["prompt"]), "SELECT prompt FROM bank WHERE p_partkey % 4 = 0", "bank")
register("q17_implied_reward", lambda s, d: P.implied_reward(X.rewards(s, d)).select("unit", "p_partkey", "reward_delta", "pref_prob", "prefers_chosen"), "SELECT unit, p_partkey, x AS reward_delta, 1 / (1 + exp(-x)) AS pref_prob, x > 0 AS prefers_chosen FROM (SELECT unit, p_partkey, 0.1::DOUBLE * ((chosen_logp - rejected_logp) - (ref_chosen_logp - ref_rejected_logp)) AS x FROM rewards)", "rewards", "reward_delta pref_prob")


def targets(s, d):
    names, units = X.policies(s, d).select("policy").distinct(), X.people(s, d).select("unit").distinct()
    own = P.evaluation_targets(names.where("policy <> 'base'"), units, "self").withColumn("mode", F.lit("self"))
    every = P.evaluation_targets(names, units).withColumn("mode", F.lit("all"))
    some = P.evaluation_targets(names, units, "selected", [("base", "N03")]).withColumn("mode", F.lit("selected"))
    return own.union(every).union(some).groupBy("mode").agg(F.count("*").alias("n"), F.max("policy").alias("last"))


register("q18_targets", targets, "SELECT 'all' AS mode, (SELECT count(DISTINCT policy) FROM policies) * (SELECT count(DISTINCT unit) FROM people) AS n, max(policy) AS last FROM policies UNION ALL SELECT 'self', count(DISTINCT policy), max(policy) FROM policies WHERE policy <> 'base' UNION ALL SELECT 'selected', 1, 'base'", "policies people")
register("q19_identity_classes", lambda s, d: P.identity_classes(X.labelled(s, d), "unit", "p_partkey", "chosen_option").select(F.array_join("members", ",").alias("members"), "n"), "SELECT string_agg(unit, ',' ORDER BY unit) AS members, count(*) AS n FROM (SELECT unit, string_agg(p_partkey || chosen_option, '|' ORDER BY p_partkey) AS v FROM labelled GROUP BY 1) GROUP BY v", "labelled")
register("q20_sign_classes", lambda s, d: P.sign_vectors(X.anchors(s, d)).groupBy("signs").agg(F.array_join(F.sort_array(F.collect_list("unit")), ",").alias("members"), F.count("*").alias("n")), "SELECT signs, string_agg(unit, ',' ORDER BY unit) AS members, count(*) AS n FROM (SELECT unit, string_agg(CASE WHEN z >= 0 THEN '+' ELSE '-' END, '' ORDER BY dimension) AS signs FROM anchors GROUP BY 1) GROUP BY 1", "anchors")
register("q21_sample_sizes", lambda s, d: P.sample_sizes(X.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("unit")).agg(F.count("*").alias("n")), [5, 50, 100000]).select("unit", "size", "used", "skipped"), "SELECT c_nationkey AS unit, size, CASE WHEN count(*) >= size THEN size END AS used, count(*) < size AS skipped FROM customer, (VALUES (5), (50), (100000)) v(size) GROUP BY 1, 2", ints="unit size used")
register(
    "q22_nested_export",
    lambda s, d: P.nested_export(X.gated(s, d), X.anchors(s, d), [5, 20], "p_partkey", "run-1", "2026-01-01T00:00:00", "export").select("unit", "p_partkey", "chosen_option", "sample_size", "sample_rank", "run_id", "export_timestamp", F.array_join(F.map_keys("profile"), ",").alias("dimensions"), F.col("profile")["risk"].alias("risk")),
    """SELECT unit, p_partkey, chosen_option, size AS sample_size, k AS sample_rank, 'run-1' AS run_id, '2026-01-01T00:00:00' AS export_timestamp, dimensions, risk FROM (SELECT unit, p_partkey, chosen_option, row_number() OVER (PARTITION BY unit ORDER BY md5('export|' || p_partkey), p_partkey) AS k FROM gated WHERE qc_status = 'pass')
    JOIN (SELECT unit, string_agg(dimension, ',' ORDER BY dimension) AS dimensions, max(z) FILTER (dimension = 'risk') AS risk FROM anchors GROUP BY 1) USING (unit), (VALUES (5), (20)) v(size) WHERE k <= size""",
    "gated anchors",
    "risk",
    "sample_size",
)
register("q23_even_allocation", lambda s, d: X.table(s, d, "nation").select("n_nationkey", C.even_allocation(F.lit(1234), F.col("n_nationkey"), F.lit(25)).alias("share")), "SELECT n_nationkey, 1234 // 25 + (n_nationkey < 1234 % 25)::INT AS share FROM nation", ints="n_nationkey share")


def twins(s, d):
    """Every adapter against base, item by item, over the units that both are evaluated on."""
    rows = X.evaluated(s, d)
    left = rows.where("policy <> 'base'").select("policy", "unit", "item", F.col("tvd").alias("ta"), F.col("mean_q").alias("ma"))
    both = left.join(rows.where("policy = 'base'").select("unit", "item", F.col("tvd").alias("tb"), F.col("mean_q").alias("mb")), ["unit", "item"])
    gap = F.abs(F.col("ta") - F.col("tb"))
    return both.groupBy("policy", "item").agg(F.avg(F.abs(F.col("ma") - F.col("mb"))).alias("mean_gap"), F.percentile(gap, 0.5).alias("median_tvd_gap"), F.max(gap).alias("max_tvd_gap"))


register("q24_twin_reliability", twins, "SELECT a.policy, item, avg(abs(a.mean_q - b.mean_q)) AS mean_gap, quantile_cont(abs(a.tvd - b.tvd), 0.5) AS median_tvd_gap, max(abs(a.tvd - b.tvd)) AS max_tvd_gap FROM evaluated a JOIN evaluated b USING (unit, item) WHERE a.policy <> 'base' AND b.policy = 'base' GROUP BY 1, 2", "evaluated", "mean_gap median_tvd_gap max_tvd_gap")
register("q25_write_back", lambda s, d: K.many_to_one(X.bank_rows(s, d).select("p_partkey", "seq"), X.bank(s, d).select("p_partkey", "m_a"), ["p_partkey"]), "SELECT p_partkey, r.seq, b.m_a FROM bank_rows r JOIN bank b USING (p_partkey)", "bank_rows bank", "m_a", "seq")
register("q26_record_fields", lambda s, d: X.table(s, d, "events").select("event_id", K.record_fields(F.to_json(F.struct("user_id", "event_type")), ["user_id", "value"]).alias("f")).select("event_id", F.array_join("f.missing", ",").alias("missing"), F.array_join("f.extra", ",").alias("extra")), "SELECT event_id, 'value' AS missing, 'event_type' AS extra FROM events")

# Contracts and text jobs
register("c1_expectations", lambda s, d: K.expect(X.missing(s, d), {"value_known": F.col("value") >= 0, "weight_known": F.col("weight").isNotNull(), "item_named": F.col("item").startswith("I")}), "SELECT * FROM (SELECT 'value_known' AS \"check\", count(*) FILTER (value < 0) = 0 AS passed, count(*) FILTER (value < 0) AS observed FROM missing UNION ALL SELECT 'weight_known', count(*) FILTER (weight IS NULL) = 0, count(*) FILTER (weight IS NULL) FROM missing UNION ALL SELECT 'item_named', TRUE, 0)", "missing")


def checked(s, d):
    """The same rules, checked while the rows are written."""
    rules = {"value_known": F.col("value") >= 0, "weight_known": F.col("weight").isNotNull(), "item_named": F.col("item").startswith("I")}
    return K.checked_write(X.missing(s, d), scratch(s, "checked"), rules, stop=False)


register("c1_checked_write", checked, "SELECT * FROM (SELECT 'value_known' AS \"check\", count(*) FILTER (value < 0) = 0 AS passed, count(*) FILTER (value < 0) AS observed FROM missing UNION ALL SELECT 'weight_known', count(*) FILTER (weight IS NULL) = 0, count(*) FILTER (weight IS NULL) FROM missing UNION ALL SELECT 'item_named', TRUE, 0)", "missing")
register("c1_probabilities_sum", lambda s, d: K.probabilities_sum(X.people(s, d), ["unit", "item"]), "SELECT count(*) AS cells, 0 AS broken FROM (SELECT DISTINCT unit, item FROM people)", "people", ints="broken")
register("c1_same_as_stored", lambda s, d: K.same_as(X.means(s, d), X.means(s, d).withColumn("mean", F.when(F.col("item") == "I2", F.col("mean") + 1).otherwise(F.col("mean"))), ["unit", "item"], "mean"), "SELECT count(*) AS keys, 0 AS only_one, count(*) FILTER (item = 'I2') AS different FROM means", "means", ints="only_one")
register("j1_unique_keys", lambda s, d: K.unique_keys(X.bank_rows(s, d), ["p_partkey"]), "SELECT count(*) AS keys, count(*) FILTER (n > 1) AS repeated FROM (SELECT p_partkey, count(*) AS n FROM bank_rows GROUP BY 1)", "bank_rows")
register("s11_profile", lambda s, d: K.profile(X.missing(s, d).select("item", "weight"), ["item"]), "SELECT item, count(*) AS n, avg((weight IS NOT NULL)::INT) AS share_weight FROM missing GROUP BY 1", "missing", "share_weight")


def damaged(s, d):
    key = F.col("event_id") % 4
    body = F.to_json(F.struct("user_id", "event_type"))
    raw = F.when(key == 0, body).when(key == 1, F.concat(F.lit("```json\n"), F.regexp_replace(body, r"\}$", ",}"), F.lit("\n```"))).when(key == 2, F.lit("no object here")).otherwise(F.concat(F.lit("so: "), F.regexp_replace(body, ":", "=")))
    return K.normalised_answers(X.table(s, d, "events").select("event_id", raw.alias("raw")), "raw", "user_id long, event_type string")


register("f1_answers", lambda s, d: damaged(s, d).select("event_id", F.when(F.col("reason").isNull(), F.col("parsed.user_id")).alias("user_id"), F.when(F.col("reason").isNull(), F.col("parsed.event_type")).alias("event_type"), "reason"), "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN user_id END AS user_id, CASE WHEN event_id % 4 < 2 THEN event_type END AS event_type, CASE event_id % 4 WHEN 2 THEN 'no object' WHEN 3 THEN 'not JSON' END AS reason FROM events")


def prompts(s, d):
    lines = X.anchors(s, d).groupBy("unit").agg(F.sort_array(F.collect_list(F.struct("dimension", F.round("z", 9).alias("z")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["dimension"], F.lit(": "), F.format_string("%+.2f", x["z"]), F.lit(" "), C.magnitude(x["z"]))), "\n")
    codes, labels = F.array(F.lit("1"), F.lit("2")), F.array(F.lit("yes"), F.lit("no"))
    return lines.select("unit", F.concat(text, F.lit("\n"), C.option_lines(codes, labels)).alias("prompt"))


register("f2_prompts", prompts, "SELECT unit, string_agg(dimension || ': ' || printf('%+.2f', round(z, 9)) || ' ' || CASE WHEN abs(z) < 0.1 THEN 'near_zero' ELSE CASE WHEN abs(z) < 0.4 THEN 'moderate_' ELSE 'strong_' END || CASE WHEN z >= 0 THEN 'positive' ELSE 'negative' END END, chr(10) ORDER BY dimension) || chr(10) || '1: yes' || chr(10) || '2: no' AS prompt FROM anchors GROUP BY unit", "anchors")


def validity(s, d):
    """Answers by unit and source; codes of I6 are 1 to 40 only, and texts of dear lines count as cut off."""
    answers = X.answers(s, d).select(F.col("source").alias("policy"), "unit", "item", F.col("value").cast("int").cast("string").alias("answer"), (F.col("price") > 50000).alias("truncated"), "l_orderkey", "l_linenumber", "value", "price")
    most = {"I1": 7, "I2": 10, "I3": 8, "I4": 3, "I5": 2, "I6": 40, "I7": 5}
    spec = s.createDataFrame([(i, [str(k) for k in range(1, n + 1)]) for i, n in most.items()], "item string, codes array<string>")
    return K.answer_validity(answers, spec, ["l_orderkey", "l_linenumber", "value", "price"])


register(
    "f3_answer_validity",
    validity,
    """SELECT policy, unit, count(*) AS n_questions, count(*) FILTER (ok) AS valid, avg(ok::INT) AS valid_rate, count(*) FILTER (price > 50000) AS truncated FROM (SELECT *, value >= 1 AND value <= CASE item WHEN 'I1' THEN 7 WHEN 'I2' THEN 10 WHEN 'I3' THEN 8 WHEN 'I4' THEN 3 WHEN 'I5' THEN 2 WHEN 'I6' THEN 40 ELSE 5 END AS ok FROM
    (SELECT source AS policy, unit, item, arg_min(value, struct_pack(a := l_orderkey, b := l_linenumber, c := value, d := price)) AS value, arg_min(price, struct_pack(a := l_orderkey, b := l_linenumber, c := value, d := price)) AS price FROM answers GROUP BY 1, 2, 3)) GROUP BY 1, 2""",
    "answers",
    "valid_rate",
)
register("f4_item_map", lambda s, d: X.means(s, d).select("item").distinct().withColumn("dimension", F.when(F.col("item") != "I6", X.lookup(F.col("item"), X.DIMENSIONS))).agg(F.count("*").alias("rows"), F.count("dimension").alias("mapped"), F.count_if(F.col("dimension").isNull()).alias("unmapped")), "SELECT count(*) AS rows, count(*) FILTER (item <> 'I6') AS mapped, count(*) FILTER (item = 'I6') AS unmapped FROM (SELECT DISTINCT item FROM means)", "means")


def receipts(s, d):
    """Runs of three stages: run 2 has no eval, run 5 labels by another protocol, and the newest event of some stages is an error."""
    stage = F.element_at(F.array(*(F.lit(x) for x in ("generate", "label", "eval"))), (F.col("event_id") % 3 + 1).cast("int"))
    rows = X.table(s, d, "events").select((F.col("user_id") % 10).cast("string").alias("run_id"), stage.alias("stage"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("event_id").alias("mtime"))
    rows = rows.where("not (run_id = '2' and stage = 'eval')").withColumn("protocol_hash", F.when(F.expr("run_id = '5' and stage = 'label'"), "g").otherwise("h"))
    return K.stage_report(rows, ["generate", "label", "eval"]).select("run_id", "hashes", "failed", F.array_join("missing", ",").alias("missing"), "ok")


register(
    "f5_stage_report",
    receipts,
    """SELECT run_id, count(DISTINCT hash) AS hashes, count(*) FILTER (status = 'error') AS failed, CASE WHEN count(*) FILTER (stage = 2) = 0 THEN 'eval' ELSE '' END AS missing, count(*) = 3 AND count(DISTINCT hash) = 1 AND count(*) FILTER (status = 'error') = 0 AS ok
    FROM (SELECT CAST(user_id % 10 AS VARCHAR) AS run_id, event_id % 3 AS stage, arg_max(event_type, event_id) AS status, CASE WHEN user_id % 10 = 5 AND event_id % 3 = 1 THEN 'g' ELSE 'h' END AS hash FROM events WHERE NOT (user_id % 10 = 2 AND event_id % 3 = 2) GROUP BY 1, 2, 4) GROUP BY 1""",
)
register("f6_anchor_item_means", lambda s, d: X.missing(s, d).where("value >= 0").groupBy("unit", "item").agg(F.round(F.avg("value"), 3).alias("mean")).withColumn("dimension", X.lookup(F.col("item"), X.DIMENSIONS)), f"SELECT unit, item, round(avg(value), 3) AS mean, {X.sql_lookup('item', X.DIMENSIONS)} AS dimension FROM missing WHERE value >= 0 GROUP BY 1, 2", "missing", "mean")

# Sinks and streams, written to the shared folder and read again


def json_and_csv(s, d):
    path = scratch(s, "both")
    rows = X.means(s, d)
    files.write_both(rows, path, ["item"])
    text = files.json_lines(s, f"{path}/json", "unit string, mean double, n long, item string").select("unit", "item", "mean")
    return files.csv(s, f"{path}/csv", "unit string, mean double, n long, item string", ["unit", "item", "n"]).join(text, ["unit", "item"])


register("s2_s3_s9_csv_and_json", json_and_csv, "SELECT unit, item, n, mean FROM means", "means", "mean")


def by_unit(s, d):
    path = scratch(s, "units")
    files.write_by_unit(X.missing(s, d), path, "unit", 4)
    return s.read.parquet(path).groupBy("unit", "item").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


register("s8_units_sink", by_unit, "SELECT unit, item, count(*) AS n, sum(weight) AS weight FROM missing GROUP BY 1, 2", "missing", "weight")


def appended(s, d):
    """Twice the same keys and once all: what is there already isn't appended again."""
    path = scratch(s, "cache")
    rows = X.table(s, d, "part").select("p_partkey", "p_brand")
    for part in (rows.where("p_partkey % 2 = 0"), rows.where("p_partkey % 2 = 0"), rows):
        cache = files.append_new(part, path, ["p_partkey"])
    return cache.groupBy("p_brand").agg(F.count("*").alias("n"))


register("s12_append_cache", appended, "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")


#: Events arrive in runs: ten days each, and every 50th only after all others. So in the last run most of these are late.
RUNS, LATE = range(4), "2 days"


def in_runs(s, d, job, mode="append", prepare=None, seen=None) -> DataFrame:
    """What the job has written after all runs. Each run's events are put into one inbox, and the job takes what is new there."""
    inbox, path, state = (scratch(s, f"events-{x}") for x in ("inbox", "out", "state"))
    rows = X.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.least(F.lit(2), F.floor(F.datediff("ts", F.lit("2024-01-01")) / 10))
    out = None
    for r in RUNS:
        rows.where(F.when(F.col("event_id") % 50 == 0, 3).otherwise(day) == r).write.mode("append").parquet(inbox)
        out = jobs.run_once(job(jobs.arriving(s, inbox, rows.schema)), path, state, mode, prepare, seen)
    return out


#: When each event arrives, and the watermark that it meets there: two days behind the newest of earlier runs.
ARRIVED = """arrived AS (SELECT *, CASE WHEN event_id % 50 = 0 THEN 3 ELSE least(2, date_diff('day', DATE '2024-01-01', ts::DATE) // 10) END AS run FROM events),
    marks AS (SELECT run, date_trunc('millisecond', (SELECT max(ts) FROM arrived a WHERE a.run < r.run)) - INTERVAL 2 DAY AS mark FROM generate_series(0, 4) r(run))"""


def streamed_rates(s, d):
    rows = in_runs(s, d, lambda e: jobs.failure_rates(e, F.col("event_type") == "error", late=LATE))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "failures", "share", "closed")


register(
    "x1_failure_rates",
    streamed_rates,
    f"""WITH {ARRIVED} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, avg((event_type = 'error')::INT) AS share, avg((event_type = 'error')::INT) > 0.75 AS closed
    FROM arrived JOIN marks USING (run) WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY 1, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT mark FROM marks WHERE run = 4)""",
    doubles="share",
)

DAY = 86400


def streamed_gate(s, d):
    rows = in_runs(s, d, lambda e: jobs.last_outcomes(e, "user_id", "ts", "event_id", F.col("event_type") == "error", DAY, 7 * DAY, LATE, 5, 0.5))
    return rows.select(F.col("user_id").alias("key"), F.date_format("start", "yyyy-MM-dd").alias("day"), "seen", "share", "closed")


register(
    "x1_last_outcomes",
    streamed_gate,
    f"""WITH {ARRIVED}, heard AS (SELECT a.* FROM arrived a JOIN marks USING (run) WHERE mark IS NULL OR ts > mark), ends AS (SELECT DISTINCT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS e FROM heard)
    SELECT CAST(user_id AS VARCHAR) AS key, strftime(e - INTERVAL 1 DAY, '%Y-%m-%d') AS day, count(*) AS seen, avg(failed) AS share, count(*) >= 5 AND avg(failed) > 0.5 AS closed FROM
    (SELECT n.user_id, n.e, (h.event_type = 'error')::INT AS failed, row_number() OVER (PARTITION BY n.user_id, n.e ORDER BY h.ts DESC, h.event_id DESC) AS k FROM ends n JOIN heard h ON h.user_id = n.user_id AND h.ts < n.e AND h.ts >= n.e - INTERVAL 7 DAY WHERE n.e <= (SELECT mark FROM marks WHERE run = 4)) WHERE k <= 5 GROUP BY user_id, e""",
    doubles="share",
)


def streamed_cache(s, d):
    rows = in_runs(s, d, lambda e: jobs.first_of_keys(e.select("user_id", "event_type"), ["user_id", "event_type"]))
    return rows.groupBy("event_type").agg(F.count("*").alias("users"))


register("x2_idempotent_cache", streamed_cache, "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")


def streamed_counts(s, d):
    """Options that nobody chose are on the grid, too: here one type that the stream never has."""
    grid = X.table(s, d, "events").select("event_type").distinct().union(s.createDataFrame([("never",)], "event_type string"))
    rows = in_runs(s, d, lambda e: jobs.option_counts(e, ["event_type"], "value"), "update", jobs.on_grid(grid, ["event_type"]))
    latest = rows.where("n > 0 or batch = 0").groupBy("event_type").agg(F.max_by(F.struct("n", "weight"), F.struct("batch", "n")).alias("x"))
    return latest.select("event_type", "x.*")


register("x3_option_counts", streamed_counts, "SELECT event_type, count(*) AS n, sum(value) AS weight FROM events GROUP BY 1 UNION ALL SELECT 'never', 0, 0.0", doubles="weight")
