"""Resamples and permutations whose draws any engine can repeat: they come from hashes of the seed, the group and the draw alone."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from .order import alike, running_totals

LOW = (1 << 32) - 1
#: Bits of a place within a block: what one task has of a group's values at a time is 65,536.
BLOCK = 16
#: Hashed words that are held at a time, and resamples that a block is drawn for at a time.
WORDS, TOGETHER = 1 << 20, 32


def mixed(x: np.ndarray) -> np.ndarray:
    """32 bits, well mixed, of 32 bits. Shifts and factors are below 2^31, so products fit a long in any engine."""
    x = ((x ^ (x >> 16)) * 0x21F0AAAD) & LOW
    x = ((x ^ (x >> 15)) * 0x735A2D97) & LOW
    return x ^ (x >> 15)


def _node_hash(key: np.ndarray, node: np.ndarray) -> np.ndarray:
    return mixed(mixed(key ^ (node & LOW)) ^ (node >> 32))


def _to_the_left(h: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of m draws at nodes with hashes h, how many go left: as many as m hashed bits are set, so each with one half."""
    words = (m + 31) // 32
    ends, out = np.cumsum(words), np.zeros(len(m), np.int64)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, WORDS):
        flat = np.arange(begin, min(begin + WORDS, int(ends[-1])))
        node = np.searchsorted(ends, flat, "right")
        at = flat - (ends[node] - words[node])
        bits = mixed((h[node] + at * 0x9E3779B9) & LOW)
        left = m[node] - 32 * at
        bits = np.where(left < 32, bits & ((1 << np.minimum(left, 32)) - 1), bits)
        out += np.bincount(node, np.bitwise_count(bits), minlength=len(m)).astype(np.int64)
    return out


def _children(row, key, level, index, m):
    """The two halves of each node, without those that no draw goes to. row tells whose they are."""
    left = _to_the_left(_node_hash(key, (1 << level) | index), m)
    row, key, level = (np.concatenate([x, x]) for x in (row, key, level + 1))
    index, m = np.concatenate([2 * index, 2 * index + 1]), np.concatenate([left, m - left])
    some = m > 0
    return row[some], key[some], level[some], index[some], m[some]


def _whole_parts(n: np.ndarray, key: np.ndarray, block: int):
    """Deals n draws each among n places. Gives row, key, level, index, m: nodes of no more than 2^block places, all of them among the n, and their draws.

    The places are the first leaves of a binary tree. Draws that fall beyond the last place start anew at the root, with bits of
    their own; so each draw has each place with the same chance, exactly.
    """
    depth = np.array([int(v - 1).bit_length() for v in n.tolist()], np.int64)
    zero = np.zeros(len(n), np.int64)
    now, done = (np.arange(len(n)), key, zero, zero, n.astype(np.int64)), []
    while len(now[0]):
        row, key, level, index, m = now
        size = depth[row] - level
        first, last = index << size, (index + 1) << size
        beyond, whole = first >= n[row], (last <= n[row]) & (size <= block)
        done.append([x[whole] for x in now])
        start = np.zeros(int(beyond.sum()), np.int64)
        again = (row[beyond], mixed(_node_hash(key[beyond], (1 << level[beyond]) | index[beyond]) ^ 0x5851F42D), start, start, m[beyond])
        rest = ~beyond & ~whole
        more = _children(row[rest], key[rest], level[rest], index[rest], m[rest])
        now = tuple(np.concatenate(pair) for pair in zip(again, more, strict=True))
    return (np.concatenate(parts) for parts in zip(*done, strict=True)) if done else now


def _parts_of_resamples(batches, bits: int):
    for batch in batches:
        n, seed, rep = (batch.column(k).to_numpy() for k in range(3))
        row, key, level, index, m = _whole_parts(n, mixed((seed ^ rep) & LOW), bits)
        depth = np.array([int(v - 1).bit_length() for v in n.tolist()], np.int64)[row]
        block = (index << (depth - level)) >> bits
        own = [pa.array(x) for x in (rep[row].astype(np.int64), key, level, index, m, depth, block)]
        yield pa.RecordBatch.from_arrays([batch.column("group").take(pa.array(row)), *own], names=["group", "rep", "key", "level", "index", "m", "depth", "block"])


def _block_sums(parts: pa.Table, values: pa.Table, bits: int) -> pa.Table:
    """rep, s: the sum of a block's values in each resample. values: i (place), x."""
    x, inside = np.zeros(1 << bits), (1 << bits) - 1
    x[values.column("i").to_numpy() & inside] = values.column("x").to_numpy()
    rep, key, level, index, m, depth = (parts.column(c).to_numpy() for c in ("rep", "key", "level", "index", "m", "depth"))
    reps, row = np.unique(rep, return_inverse=True)
    sums = np.zeros(len(reps))
    for begin in range(0, len(reps), TOGETHER):
        own = (row >= begin) & (row < begin + TOGETHER)
        now = (row[own], key[own], level[own], index[own], m[own])
        while len(now[0]):
            leaf = now[2] == depth[0]
            sums += np.bincount(now[0][leaf], now[4][leaf] * x[now[3][leaf] & inside], minlength=len(reps))
            now = _children(*(v[~leaf] for v in now))
    return pa.table({"rep": pa.array(reps), "s": pa.array(sums)})


def bootstrap_mean(rows: DataFrame, group: list[str], value: str, order: list[str], reps: int = 2000, seed: str = "boot", level: float = 0.95, block: int = BLOCK) -> DataFrame:
    """group, n, mean, low, high: percentile interval of the means of `reps` resamples of the finite values. order tells any two of a group's values apart.

    A resample is n draws with replacement. How many of them fall to which block of values is told by splitting counts down a tree,
    by hashed bits: a block gets a few counts for each resample, whatever n is, and deals its draws among its own values where they
    are. So neither values nor draws are exploded or joined one by one; what is shuffled is the values once, and counts and sums of
    blocks. A block has 2^block values.
    """
    x = F.col(value).cast("double")
    there = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*group, *(o for o in order if o not in group), x.alias("__x"))
    placed = running_totals(there, [o for o in order if o not in group], F.lit(1), group)
    named = F.struct(*group).alias("group") if group else F.struct(F.lit(0).alias("all")).alias("group")
    values = placed.select(named, F.col("before").alias("i"), F.col("__x").alias("x"), F.shiftright("before", block).alias("block"))
    sizes = placed.groupBy(*group).agg(F.count("*").alias("n"), F.avg("__x").alias("mean"))
    name = C.hash_int(F.lit(seed), F.concat_ws("/", *(F.col(g).cast("string") for g in group)))
    draws = sizes.select("n", name.alias("seed"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(reps).cast("long"))).alias("rep"), named)
    kind = values.schema["group"].dataType.simpleString()
    parts = draws.mapInArrow(lambda batches: _parts_of_resamples(batches, block), f"group {kind}, rep long, key long, level long, index long, m long, depth long, block long")

    def sums(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = _block_sums(left, right, block)
        return out.append_column("group", right.column("group").take(pa.array(np.zeros(len(out), np.int64))))

    drawn = parts.groupBy("group", "block").cogroup(values.groupBy("group", "block")).applyInArrow(sums, f"rep long, s double, group {kind}")
    tail = (1 - level) / 2
    means = alike(drawn.groupBy("group", "rep").agg(F.sum("s").alias("s")), sizes.select(named, "n"), ["group"]).withColumn("m", F.col("s") / F.col("n"))
    # As many values a group as there are resamples.
    bounds = means.groupBy("group").agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))
    return alike(sizes.withColumn("group", named), bounds, ["group"]).select(*group, "n", "mean", "low", "high")


def bootstrap_sql(values: str, group: list[str], reps: int, seed: str = "boot") -> str:
    """The same in SQL: group, n, mean, low, high of a table of group, i (place from 0) and x. Draw by draw down the tree; for small tables."""
    g = ", ".join(group)
    name = " || '/' || ".join(group)
    low = LOW

    def mixed_in(x: str) -> str:
        """One expression; lists of one stand in for names."""
        return f"[xor(x3, x3 >> 15) FOR x3 IN [(xor(x2, x2 >> 15) * {0x735A2D97}) & {low} FOR x2 IN [(xor(x1, x1 >> 16) * {0x21F0AAAD}) & {low} FOR x1 IN [{x}]]]][1]"

    word = mixed_in(f"(h + c * {0x9E3779B9}) & {low}")
    step = f"SELECT *, {mixed_in('xor(k1, node >> 32)')} AS h FROM (SELECT *, {mixed_in(f'xor(key, node & {low})')} AS k1 FROM (SELECT *, (1::BIGINT << level) | idx AS node FROM t WHERE level < depth OR idx << (depth - level) >= n))"
    step = f"SELECT *, CASE WHEN idx << (depth - level) < n THEN list_sum([bit_count({word} & CASE WHEN m - 32 * c < 32 THEN (1::BIGINT << (m - 32 * c)) - 1 ELSE {low} END) FOR c IN range(0, (m + 31) // 32)]) ELSE 0 END::BIGINT AS l FROM ({step})"
    again = mixed_in(f"xor(h, {0x5851F42D})")
    kids = f"CASE WHEN idx << (depth - level) >= n THEN [struct_pack(k := {again}, v := 0::BIGINT, j := 0::BIGINT, c := m)] ELSE [struct_pack(k := key, v := level + 1, j := 2 * idx, c := l), struct_pack(k := key, v := level + 1, j := 2 * idx + 1, c := m - l)] END"
    return f"""WITH RECURSIVE v AS MATERIALIZED ({values}), z AS MATERIALIZED (SELECT {g}, count(*)::BIGINT AS n, avg(x) AS mean, CASE WHEN count(*) = 1 THEN 0 ELSE length(bin(count(*) - 1)) END::BIGINT AS depth, ('0x' || substr(md5('{seed}|' || {name}), 1, 8))::BIGINT AS s FROM v GROUP BY {g}),
    t AS (SELECT {g}, n, depth, rep, {mixed_in("xor(s, rep)")} AS key, 0::BIGINT AS level, 0::BIGINT AS idx, n AS m FROM z, generate_series(1, {reps}) r(rep)
    UNION ALL SELECT {g}, n, depth, rep, q.k, q.v, q.j, q.c FROM (SELECT {g}, n, depth, rep, unnest({kids}) AS q FROM ({step})) WHERE q.c > 0)
    SELECT {", ".join(f"z.{c}" for c in group)}, z.n, z.mean, low, high FROM z JOIN (SELECT {g}, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT {", ".join(f"t.{c}" for c in group)}, rep, sum(t.m * v.x) / max(t.n) AS m FROM t JOIN v ON {" AND ".join(f"t.{c} = v.{c}" for c in group)} AND v.i = t.idx WHERE t.level = t.depth AND t.idx < t.n GROUP BY ALL) GROUP BY {g}) USING ({g})"""


def permutations(units: DataFrame, reps: int, seed: str = "perm", unit: str = "unit", group: list[str] | None = None) -> DataFrame:
    """group, unit, dealt: for each unit an array with one number for each of `reps` deals, the place (from 1, in order of the group's units) of the unit whose label it gets.

    A deal gives each unit one place of its group, without replacement. units: one row a unit (a population); each deal is a window of its own.
    """
    group = group or []
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), F.col(unit)).cast("binary"))
    rep = units.select(*group, unit).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    placed = rep.withColumn("place", F.row_number().over(W.partitionBy(*group, "rep").orderBy(draw, unit)))
    return placed.groupBy(*group, unit).agg(F.transform(F.sort_array(F.collect_list(F.struct("rep", "place"))), lambda s: s["place"]).alias("dealt"))


def packed_sums(rows: DataFrame, columns: list[str], group: list[str], add: Callable[..., np.ndarray], reps: int, width: int = 1) -> DataFrame:
    """group, rep, s0 ..: sums over rows of `width` numbers for each of the deals, without a row for each row and deal.

    add turns one row's columns (arrays as NumPy arrays) into an array of width x reps. A task adds its rows up, and gives one row
    for each of its groups and deals.
    """

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(len(group))), strict=True)) if group else [()] * batch.num_rows
            own = [c.to_pylist() if not pa.types.is_list(c.type) else [np.asarray(v.values) for v in c] for c in (batch.column(k) for k in range(len(group), batch.num_columns))]
            for k, *values in zip(keys, *own, strict=True):
                if k not in held:
                    held[k] = np.zeros((width, reps))
                held[k] += add(*values)
        for k, sums in held.items():
            parts = [pa.array([v] * reps, batch.column(j).type) for j, v in enumerate(k)]
            yield pa.RecordBatch.from_arrays([*parts, pa.array(np.arange(1, reps + 1)), *(pa.array(s) for s in sums)], names=[*group, "rep", *(f"s{j}" for j in range(width))])

    kinds = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group), "rep long", *(f"s{j} double" for j in range(width))])
    sums = rows.select(*group, *columns).mapInArrow(run, kinds)
    return sums.groupBy(*group, "rep").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(width)))


def permuted_class_means(pairs: DataFrame, classes: DataFrame, reps: int, seed: str = "perm") -> DataFrame:
    """rep, within, between, ratio: mean distances inside and across classes, with the classes dealt anew to the units. pairs: a, b, d; classes: unit, class.

    Each unit's labels of all deals are one array; a pair meets two of them, once, however many deals there are.
    """
    places = classes.agg(F.transform(F.sort_array(F.collect_list(F.struct("unit", "class"))), lambda s: s["class"]).alias("__classes"))
    codes = classes.select("class").distinct().agg(F.sort_array(F.collect_list("class")).alias("__codes"))
    dealt = permutations(classes, reps, seed).crossJoin(F.broadcast(places)).crossJoin(F.broadcast(codes))
    labels = dealt.select("unit", F.transform("dealt", lambda p: F.array_position("__codes", F.get("__classes", p - 1)).cast("int")).alias("labels"))
    side = lambda k: labels.select(F.col("unit").alias(k), F.col("labels").alias(f"of_{k}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("d is not null")

    def add(d, one, two):
        inside = one == two
        return np.stack([inside * d, inside, ~inside * d, ~inside]).astype(float)

    sums = packed_sums(met.select(F.col("d").cast("double").alias("d"), "of_a", "of_b"), ["d", "of_a", "of_b"], [], add, reps, 4)
    out = sums.select("rep", F.try_divide("s0", "s1").alias("within"), F.try_divide("s2", "s3").alias("between"))
    return out.withColumn("ratio", F.try_divide("within", "between"))


def permuted_correlations(rows: DataFrame, group: list[str], x: str, z: str, reps: int, seed: str = "perm", least: int = 8) -> DataFrame:
    """group, rep, rho: rank correlations of x and z within each group, with z dealt anew to the group's units. rows: group, unit, x, z, one row a unit.

    Dealing doesn't change ranks, so they are formed once; a deal's correlation is a sum of products of ranks, all deals of a unit
    at a time. Null where a side is constant or the group has fewer than `least` units.
    """
    from .summaries import average_ranks

    ranked = average_ranks(rows.where(F.col(x).isNotNull() & F.col(z).isNotNull()), group, [x, z])
    ranks = ranked.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("unit", f"rank_{z}"))), lambda s: s[f"rank_{z}"]).alias("__zs"), F.count("*").alias("__n"), F.avg(f"rank_{x}").alias("__mx"), F.avg(f"rank_{z}").alias("__mz"), F.var_pop(f"rank_{x}").alias("__vx"), F.var_pop(f"rank_{z}").alias("__vz"))
    dealt = permutations(ranked, reps, seed, group=group)
    met = alike(alike(ranked.select(*group, "unit", F.col(f"rank_{x}").alias("__r")), ranks.select(*group, "__zs"), group), dealt, [*group, "unit"])
    sums = packed_sums(met, ["__r", "__zs", "dealt"], group, lambda r, zs, places: (r * zs[places - 1])[None, :], reps)
    full = alike(sums, ranks.drop("__zs"), group)
    rho = (F.col("s0") / F.col("__n") - F.col("__mx") * F.col("__mz")) / F.sqrt(F.col("__vx") * F.col("__vz"))
    return full.select(*group, "rep", F.when((F.col("__n") >= least) & (F.col("__vx") > 0) & (F.col("__vz") > 0), rho).alias("rho"))


def permuted_medians(ranks: DataFrame, reps: int, seed: str = "perm") -> DataFrame:
    """rep, median: the median over policies of the rank that the dealt unit has for each. ranks: unit (the policy's own), other, rank."""
    of = ranks.groupBy("unit").agg(F.transform(F.sort_array(F.collect_list(F.struct("other", "rank"))), lambda s: s["rank"]).alias("__ranks"))
    met = of.join(permutations(of, reps, seed), "unit").select(F.posexplode(F.transform("dealt", lambda p: F.get("__ranks", p - 1))).alias("rep", "rank"))
    return met.groupBy((F.col("rep") + 1).cast("long").alias("rep")).agg(F.percentile("rank", 0.5).alias("median"))


def permutation_summary(value: str, observed: Column, less: bool = True, plus_one: bool = False) -> list[Column]:
    """Aggregates over the null's values: p (share at most, or at least, as large as observed), their 5th and 95th percentile and deviation."""
    hit = F.col(value) <= observed if less else F.col(value) >= observed
    k = 1 if plus_one else 0
    return [((F.count_if(hit) + k) / (F.count(value) + k)).alias("p"), F.percentile(value, 0.05).alias("p05"), F.percentile(value, 0.95).alias("p95"), F.stddev_samp(value).alias("null_sd")]
