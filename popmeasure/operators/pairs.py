"""Preference pairs: banks without repeats, labels by sign, quality gates, splits, rewards, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.shared import written
from .summaries import nested_sample


def bank(rows: DataFrame, key: list[str], order: list[str], text: tuple[str, str] = ("response_a", "response_b")) -> DataFrame:
    """One row a key, the first by order, with versions: in how many ways the key's two texts are given."""
    whole = F.struct(*(F.col(c) for c in rows.columns if c not in key))
    first = rows.groupBy(*key).agg(F.min_by(whole, F.struct(*order)).alias("r"), F.count("*").alias("copies"), F.count_distinct(F.struct(*text)).alias("versions"))
    return first.select(*key, "r.*", "copies", "versions")


def without_conflicts(rows: DataFrame) -> DataFrame:
    """A bank() that is an error if any key has several versions."""
    return rows.where(F.when(F.col("versions") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("a key has different texts")).cast("boolean")))


def flagged_conflicts(rows: DataFrame) -> DataFrame:
    """A bank() with conflict: whether a key has several versions. Such keys can be set aside without an error."""
    return rows.withColumn("conflict", F.col("versions") > 1)


def rotate_scores(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Chosen and rejected scores turned back to options A and B; null where the choice is neither."""
    pick = lambda a, b: F.when(F.col("chosen_option") == "A", F.col(a)).when(F.col("chosen_option") == "B", F.col(b))
    out = {f"m_a_{d}": pick(f"m_chosen_{d}", f"m_rejected_{d}") for d in dimensions} | {f"m_b_{d}": pick(f"m_rejected_{d}", f"m_chosen_{d}") for d in dimensions}
    return rows.withColumns(out)


def label_pairs(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each pair for each unit, on the pair's dimension: A is chosen where z is 0 or more. anchors: unit, dimension, z.

    The anchors (units x dimensions) are small and are joined by dimension; a z that isn't finite is an error.
    """
    sure = F.when(C.finite(F.col("z")).isNotNull(), F.col("z")).otherwise(F.raise_error(F.lit("z is not finite")).cast("double"))
    both = rows.join(F.broadcast(anchors.withColumn("z", sure)), "dimension")
    up = F.col("z") >= 0
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    return both.withColumns(
        {
            "chosen_option": F.when(up, "A").otherwise("B"),
            "chosen": pick("response_a", "response_b"),
            "rejected": pick("response_b", "response_a"),
            "m_chosen": pick("m_a", "m_b"),
            "m_rejected": pick("m_b", "m_a"),
            "near_zero_z": C.near_zero(F.col("z")),
        }
    ).withColumn("m_diff_signed", F.round(F.col("m_chosen") - F.col("m_rejected"), 4))


def quality_gates(rows: DataFrame, margin: float = 0.03, least: float = 0.20) -> DataFrame:
    """rows: z, m_chosen, m_rejected (null if unscored). Adds signed, mono_pass, dist_pass, qc_status and its reason; no row goes."""
    signed = F.col("m_chosen") - F.col("m_rejected")
    side = F.when(F.col("z") < 0, -1.0).otherwise(1.0)
    out = rows.withColumn("signed", signed).withColumns({"mono_pass": F.coalesce(F.col("signed") * side > -margin, F.lit(False)), "dist_pass": F.coalesce(F.abs("signed") >= least, F.lit(False))})
    status = F.when(F.col("signed").isNull(), "score_fail").when(~F.col("mono_pass"), "mono_fail").when(~F.col("dist_pass"), "dist_fail").otherwise("pass")
    reason = F.when(F.col("signed").isNull(), "no scores").when(~F.col("mono_pass"), "order against the anchor").when(~F.col("dist_pass"), "scores too close").otherwise("")
    return out.withColumns({"qc_status": status, "failure_reason": reason})


def contamination(a: Column, b: Column, target: Column) -> Column:
    """Summed gaps of the dimensions other than target, over the target's gap, to 4 digits; null where that is 0. a, b: maps by dimension."""
    gap = lambda k: F.abs(F.element_at(a, k) - F.element_at(b, k))
    rest = F.aggregate(F.filter(F.map_keys(a), lambda k: k != target), F.lit(0.0), lambda s, k: s + F.coalesce(gap(k), F.lit(0.0)))
    return F.when(gap(target) > 0, F.round(rest / gap(target), 4))


def status_counts(rows: DataFrame, dimension: str = "dimension") -> DataFrame:
    """Counts of each status by dimension and, with a null dimension, of all, in one pass."""
    count = lambda s: F.count_if(F.col("qc_status") == s).alias(s)
    return rows.rollup(dimension).agg(*(count(s) for s in ("score_fail", "mono_fail", "dist_fail", "pass")), F.count("*").alias("n"))


def health(rows: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row about a bank(): rows, keys, missing texts, conflicts, and how A and B are ordered on the target dimension."""
    missing = F.col("response_a").isNull() | F.col("response_b").isNull() | (F.trim("response_a") == "") | (F.trim("response_b") == "")
    gap = F.col("m_a") - F.col("m_b")
    out = rows.agg(
        F.sum("copies").alias("rows"),
        F.count("*").alias("keys"),
        F.count_if(missing).alias("missing"),
        F.count_if(F.col("versions") > 1).alias("conflicts"),
        F.count_if(gap > tolerance).alias("polarity_ok"),
        F.count_if(gap < -tolerance).alias("polarity_inverted"),
        F.count_if(gap.isNull()).alias("unscored"),
    )
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("conflicts") == 0))


#: The pairs of levels that are set against each other.
CONTRASTS = [(-3, 3), (-1, 1), (3, 2), (-3, -2), (1, 2), (-1, -2)]


def level_pairs(rows: DataFrame, key: list[str], seed: str = "order") -> DataFrame:
    """rows: key, level, seq, text. For each contrast whose levels a key has, both texts; which one is A is dealt by hash. The last row of a level counts."""
    last = rows.groupBy(*key, "level").agg(F.max_by("text", "seq").alias("text"))
    spark = rows.sparkSession
    wanted = F.broadcast(spark.createDataFrame(CONTRASTS, "one int, two int"))
    first = last.select(*key, F.col("level").alias("one"), F.col("text").alias("text_one"))
    second = last.select(*key, F.col("level").alias("two"), F.col("text").alias("text_two"))
    both = first.join(wanted, "one").join(second, [*key, "two"])
    swap = C.hash_int(F.lit(seed), *(F.col(k).cast("string") for k in key), F.col("one").cast("string"), F.col("two").cast("string")) % 2 == 1
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return both.select(*key, pick("text_one", "text_two").alias("response_a"), pick("text_two", "text_one").alias("response_b"), pick("one", "two").alias("level_a"), pick("two", "one").alias("level_b"))


def nearest_choice(target: Column, a: Column, b: Column, conservative: bool = True) -> Column:
    """The option whose level is closer to target. Ties: the one farther from neutral, then A; or `tie`."""
    da, db = F.abs(a - target), F.abs(b - target)
    tie = F.when(F.abs(a) >= F.abs(b), "A").otherwise("B") if conservative else F.lit("tie")
    return F.when(da < db, "A").when(db < da, "B").otherwise(tie)


def materialised(rows: DataFrame) -> DataFrame:
    """chosen and rejected texts and levels by chosen_option."""
    first = F.col("chosen_option") == "A"
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    return rows.withColumns({"chosen": pick("response_a", "response_b"), "rejected": pick("response_b", "response_a"), "chosen_level": pick("level_a", "level_b"), "rejected_level": pick("level_b", "level_a")})


def split_by_prompt(rows: DataFrame, prompt: str, share: float = 0.8, seed: str = "split") -> DataFrame:
    """rows with part: train for the first int(n * share) distinct prompts in hash order, the same for all units.

    Prompts are ranked within hash ranges whose sizes are summed before, so no task orders all of them.
    """
    draw = C.hash_int(F.lit(seed), F.col(prompt))
    return _ranked_share(rows, rows.select(F.col(prompt).alias("__p"), draw.alias("__h")).distinct(), F.col(prompt) == F.col("__p"), share)


def _ranked_share(rows: DataFrame, keys: DataFrame, match: Column, share: float) -> DataFrame:
    placed = keys.withColumn("__b", F.floor(F.col("__h") / (2**32 / 256)).cast("int"))
    sizes = placed.groupBy("__b").agg(F.count("*").alias("__k"))
    before = sizes.select(F.col("__b").alias("__c"), (F.sum("__k").over(W.orderBy("__b")) - F.col("__k")).alias("__before"), F.sum("__k").over(W.partitionBy()).alias("__total"))
    ranked = placed.join(F.broadcast(before), F.col("__b") == F.col("__c")).withColumn("__r", F.col("__before") + F.row_number().over(W.partitionBy("__b").orderBy("__h", "__p")))
    part = F.when(F.col("__r") <= F.floor(F.col("__total") * share), "train").otherwise("test")
    return rows.join(ranked.select("__p", part.alias("part")), match).drop("__p")


def split_rows(rows: DataFrame, unit: list[str], key: str, share: float = 0.8, seed: str = "split") -> DataFrame:
    """rows with part, drawn row by row within each unit."""
    at = W.partitionBy(*unit)
    rank = F.row_number().over(at.orderBy(C.hash_int(F.lit(seed), F.col(key).cast("string")), key))
    return rows.withColumn("part", F.when(rank <= F.floor(F.count("*").over(at) * share), "train").otherwise("test"))


def validation(rows: DataFrame, unit: str = "unit") -> DataFrame:
    """One row of counts of what is wrong: empty texts, equal answers, prompts that a unit has twice, and whether there are rows."""
    empty = F.greatest(*(F.coalesce(F.trim(c) == "", F.lit(True)).cast("int") for c in ("prompt", "chosen", "rejected"))) == 1
    twice = rows.groupBy(unit, "prompt").count().where("count > 1").agg(F.count("*").alias("repeated_prompts"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(empty).alias("empty_text"), F.count_if(F.col("chosen") == F.col("rejected")).alias("same_answers"))
    return counts.crossJoin(twice).withColumn("ok", (F.col("n") > 0) & (F.col("empty_text") + F.col("same_answers") + F.col("repeated_prompts") == 0))


def reference_cache(rows: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """prompt, completion, logp of both answers of each row, once each, and whether values differ by more than tolerance."""
    both = rows.select("prompt", F.explode(F.array(F.struct(F.col("chosen").alias("completion"), F.col("ref_chosen_logp").alias("logp")), F.struct(F.col("rejected").alias("completion"), F.col("ref_rejected_logp").alias("logp")))).alias("x")).select("prompt", "x.*")
    return both.groupBy("prompt", "completion").agg(F.min("logp").alias("logp"), (F.max("logp") - F.min("logp") > tolerance).alias("conflict"))


def missing_keys(wanted: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """What a cache lacks."""
    return wanted.select(*key).distinct().join(cache.select(*key), key, "left_anti")


def with_reference(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """rows with both answers' cached values; null where the cache lacks them."""
    side = lambda name: cache.select("prompt", F.col("completion").alias(name), F.col("logp").alias(f"ref_{name}"))
    return rows.join(side("chosen"), ["prompt", "chosen"], "left").join(side("rejected"), ["prompt", "rejected"], "left")


def implied_reward(rows: DataFrame, beta: float = 0.1) -> DataFrame:
    """Reward difference implied by log probabilities, its sigmoid, and whether it prefers the chosen answer."""
    delta = beta * ((F.col("chosen_logp") - F.col("rejected_logp")) - (F.col("ref_chosen_logp") - F.col("ref_rejected_logp")))
    return rows.withColumn("reward_delta", delta).withColumns({"pref_prob": C.sigmoid(F.col("reward_delta")), "prefers_chosen": F.col("reward_delta") > 0})


def evaluation_targets(policies: DataFrame, units: DataFrame, mode: str = "all", selected: list[tuple[str, str]] | None = None) -> DataFrame:
    """policy, unit pairs to evaluate: all, self, or those selected. A selected name that there isn't is an error."""
    if mode == "self":
        return policies.withColumn("unit", C.unit_name(F.col("policy"))).join(units, "unit", "left_semi").select("policy", "unit")
    grid = policies.crossJoin(F.broadcast(units))
    if mode == "all":
        return grid.select("policy", "unit")
    wanted = policies.sparkSession.createDataFrame(selected or [], "policy string, unit string")
    found = wanted.join(policies.withColumn("__p", F.lit(1)), "policy", "left").join(units.withColumn("__u", F.lit(1)), "unit", "left")
    known = F.col("__p").isNotNull() & F.col("__u").isNotNull()
    return found.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown: "), "policy", F.lit(" on "), "unit")).cast("boolean"))).select("policy", "unit")


def identity_classes(rows: DataFrame, unit: str, key: str, label: str) -> DataFrame:
    """Units whose whole vectors of labels are equal: class (a hash), members (sorted) and their number.

    A unit's rows are added up as hashes, in any order and before they are shuffled; equal sums make a class. Sums may lie, so each
    class is compared with one of its members, by an equality join row by row; units that differ form classes anew. However
    many rows a unit has, none of its vector is ever held in one place.
    """
    part = lambda k: F.sum(F.xxhash64(F.lit(k), key, label).cast("decimal(20,0)"))
    sums = rows.groupBy(unit).agg(F.md5(F.concat_ws("|", part(1).cast("string"), part(2).cast("string"), F.count("*").cast("string")).cast("binary")).alias("class"), F.count("*").alias("__n"))
    return refined(rows, sums, unit, key, label)


def refined(rows: DataFrame, sums: DataFrame, unit: str, key: str, label: str) -> DataFrame:
    """Classes of units with truly equal vectors, out of those with an equal hash. sums: unit, class, __n (its rows)."""
    cells = rows.groupBy(unit, key, label).agg(F.count("*").alias("__c"))
    open_, sure, turn = written(sums, "unit-sums"), None, 0
    while True:
        led = open_.withColumn("__first", F.min(unit).over(W.partitionBy("class")))
        # Rows of each unit that its class's first member has as often; all of them, and as many as that has, if they are equal.
        own = led.select(F.col(unit).alias("__u"), "class", "__first", "__n").join(cells, F.col("__u") == F.col(unit))
        first = cells.select(F.col(unit).alias("__f"), *(F.col(c).alias(f"__f_{c}") for c in (key, label, "__c")))
        same = [F.col("__first") == F.col("__f"), *(F.col(c).eqNullSafe(F.col(f"__f_{c}")) for c in (key, label, "__c"))]
        met = own.join(first, same, "left_semi").groupBy("__u").agg(F.sum("__c").alias("__same"))
        sizes = open_.select(F.col(unit).alias("__f"), F.col("__n").alias("__fn"))
        told = led.join(met, F.col(unit) == F.col("__u"), "left").join(sizes, F.col("__first") == F.col("__f"))
        told = written(told.select(unit, "class", "__n", ((F.coalesce("__same", F.lit(0)) == F.col("__n")) & (F.col("__n") == F.col("__fn"))).alias("__equal")), "told-units")
        found = told.where("__equal").select(unit, F.concat("class", F.lit(f"-{turn}" if turn else "")).alias("class"))
        sure = found if sure is None else sure.union(found)
        open_, turn = told.where("not __equal").select(unit, "class", "__n"), turn + 1
        if open_.isEmpty():
            return sure.groupBy("class").agg(F.sort_array(F.collect_list(unit)).alias("members"), F.count("*").alias("n"))


def sign_vectors(anchors: DataFrame) -> DataFrame:
    """unit, signs: + or - for each dimension in order of name; anchors: unit, dimension, z."""
    mark = F.when(F.col("z") >= 0, "+").otherwise("-")
    return anchors.groupBy("unit").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("dimension", mark.alias("s")))), lambda x: x["s"]), "").alias("signs"))


def nested_export(rows: DataFrame, profiles: DataFrame, sizes: list[int], key: str, run_id: str, exported_at: str, seed: str) -> DataFrame:
    """Rows that passed the gates, for each size the first so many of a unit's fixed random order, so samples nest.

    With sample_size, sample_rank, run_id, export_timestamp and the unit's profile, a map of dimension to z (profiles: unit,
    dimension, z; null for units without one).
    """
    ranked = nested_sample(rows.where("qc_status = 'pass'"), ["unit"], key, seed).where(F.col("sample_rank") <= max(sizes))
    sized = ranked.withColumn("sample_size", F.explode(F.array(*(F.lit(k) for k in sizes)))).where("sample_rank <= sample_size")
    profile = F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", "z"))))
    named = sized.withColumns({"run_id": F.lit(run_id), "export_timestamp": F.lit(exported_at)})
    return named.join(profiles.groupBy("unit").agg(profile.alias("profile")), "unit", "left")


def sample_sizes(counts: DataFrame, requested: list[int], policy: str = "skip_unavailable") -> DataFrame:
    """counts: unit, n. size, feasible size and whether it is skipped, for each unit and requested size. fail_fast makes too few an error."""
    asked = counts.withColumn("size", F.explode(F.array(*(F.lit(s) for s in requested))))
    enough = F.col("n") >= F.col("size")
    if policy == "fail_fast":
        asked = asked.where(F.when(enough, F.lit(True)).otherwise(F.raise_error(F.lit("too few rows")).cast("boolean")))
    used = F.least("size", "n") if policy == "degrade_to_feasible" else F.when(enough, F.col("size"))
    return asked.withColumns({"used": used.cast("long"), "skipped": ~enough & F.lit(policy == "skip_unavailable")})


def same_pair(group: str = "prompt") -> Column:
    """Aggregate: whether all rows of a group have the same two texts, in any order."""
    return F.count_distinct(F.array_sort(F.array("chosen", "rejected"))) == 1
