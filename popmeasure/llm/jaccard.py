"""Similarity join of documents' n-gram sets, by relations between sets.

Two documents link if their sets of word n-grams are alike enough (Jaccard). Equal sets are one node. In an order of all
n-grams that puts rare ones first, alike sets share an n-gram of each one's prefix, so an inverted index of the prefixes
finds all pairs. Two relations between sets spare most of its work, and both are exact:

* Blocks of an index list. A list is cut into blocks of sets of similar size. What an entry can still share with another
  set depends on its size and on its place in the prefix alone: from these follow the sizes that it can link with, hence
  the few blocks that it looks into, fewer the later its place. All other blocks of the list are skipped unseen.
* Answers of a similar set. Each set is compared with a leader of its lists first. Once a set's overlap with its leader is
  known, so is how many members it has more and less. The overlap of any two sets then lies between bounds that follow from
  that of their leaders, which is computed once for all pairs of sets that they lead. Only pairs that these bounds leave open are
  intersected themselves.

Pairs that other links have in one group already are not compared again, and a group meets only those outside it, so
the copies of a passage, or a group that a third of the rows is in, form no pairs among themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import documents, dropped, ready
from .components import components
from .repeats import _mixed
from .shingles import lots, window_hashes
from .similar import bit_filter, held, how_common, plausible, prefix, short_sketch, sketch

#: Turns in which sets are compared with leaders at most, leaders of a list in later turns, and the share of sets that a turn must link for another one to follow.
TURNS, TRIES, FEW = 2, 4, 0.01


#: Nodes whose index entries are formed at a time.
SLICE = 512


def written(df: DataFrame, label: str) -> DataFrame:
    """As common.written(). Many small tables of hashes: compressors would hold memory outside the heap for each of their files, and gain little."""
    return common.written(df, label, "none")


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    h = xxhash.xxh3_128_intdigest(values.tobytes())
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def prints_of(docs: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """doc_id, hi, lo, size, short, sketch, prefix of each row. The last three are null where the task has sent those of an equal set lately. Written."""
    sent = docs.sparkSession.sparkContext.broadcast(how_common(docs, shingle))

    def run(batches):
        common, known = sent.value, set()
        for batch in batches:
            for begin, texts in lots(batch.column(1)):
                sets = [np.unique(h) for h in window_hashes(texts, shingle)]
                keys = [set_key(s) for s in sets]
                new = []
                for k in keys:
                    new.append(k not in known)
                    known.add(k)
                known = known if len(known) < 20_000 else set()
                firsts = [prefix(s, common, least).view(np.int64) if n else None for s, n in zip(sets, new, strict=True)]
                shorts = [short_sketch(s) if n else None for s, n in zip(sets, new, strict=True)]
                sketches = [sketch(s) if n else None for s, n in zip(sets, new, strict=True)]
                longs = pa.list_(pa.int64())
                own = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(shorts, longs), pa.array(sketches, pa.binary()), pa.array(firsts, longs)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), *own], names=["doc_id", "hi", "lo", "size", "short", "sketch", "prefix"])

    out = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, hi long, lo long, size int, short array<long>, sketch binary, prefix array<long>"), "sets")
    sent.destroy()
    return out


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """n, set (array of hashes) of the nodes (n, hi, lo, first). Filters of fixed size keep other documents from being hashed, and other sets from the shuffle. Written."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((bit_filter(nodes.where("first is not null").select("first")), bit_filter(nodes.select("lo"))))

    def run(batches):
        firsts, lows = sent.value
        for batch in batches:
            own = batch.column(0)
            batch = batch.filter(pa.array(own.is_null().to_numpy(False) | held(firsts, own.fill_null(0).to_numpy())))
            for _, texts in lots(batch.column(1)):
                sets = [np.unique(h).view(np.int64) for h in window_hashes(texts, shingle)]
                keys = [set_key(s) for s in sets]
                keep = np.flatnonzero(held(lows, np.array([k[1] for k in keys], np.int64)))
                ends = np.r_[0, np.cumsum([len(sets[k]) for k in keep])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(sets[k] for k in keep)])))
                yield pa.RecordBatch.from_arrays([pa.array([keys[k][0] for k in keep], pa.int64()), pa.array([keys[k][1] for k in keep], pa.int64()), lists], names=["hi", "lo", "set"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "hi long, lo long, set array<long>")
    sets = found.join(nodes.select("n", "hi", "lo"), ["hi", "lo"]).groupBy("hi", "lo").agg(F.first("n").alias("n"), F.first("set").alias("set")).select("n", "set")
    out = written(sets, "compared-sets")
    sent.destroy()
    return out


def edges(percent: int) -> np.ndarray:
    """The least size of each block after the first: blocks of sizes up to the square of what linked sizes differ by, in whole numbers, so the same on all machines."""
    out = [2]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 10000 // percent**2)))
    return np.array(out)


def reach(size: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest set that one of this size can link with, if the first n-gram they share is at this place (from 0) of its prefix.

    They share size - at members at most, and must share percent / (100 + percent) of both sizes' sum.
    """
    size = size.astype(np.int64)
    return (size * percent + 99) // 100, (size - at) * (100 + percent) // percent - size


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            yield batch.slice(begin, SLICE)


def block_entries(batch: pa.RecordBatch, percent: int) -> tuple[np.ndarray, ...]:
    """k, row, at, own, look of the entries of a batch of n, size, prefix: an entry stands in its own block of its list and in each one that it looks into. k is a hash of the n-gram and the block."""
    sizes, lists = batch.column(1).to_numpy(), batch.column(2)
    counts = lists.value_lengths().to_numpy()
    keys, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
    low, high = reach(sizes[row], at, percent)
    some = low <= high
    keys, row, at, low, high = (x[some] for x in (keys, row, at, low, high))
    cuts = edges(percent)
    first, last, home = (np.searchsorted(cuts, x, "right") for x in (low, high, sizes[row]))
    begin, end = np.minimum(first, home), np.maximum(last, home)
    each = end - begin + 1
    entry = np.repeat(np.arange(len(keys)), each)
    block = begin[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(each) - each, each)
    own, look = block == home[entry], (block >= first[entry]) & (block <= last[entry])
    kept = own | look
    entry, block, own, look = (x[kept] for x in (entry, block, own, look))
    k = _mixed(keys[entry].view(np.uint64) + block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return k, row[entry], at[entry], own, look


def index_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """k (a block of an index list), n, size, at, own, look of each prefix's entries: whether the block is the entry's own, and whether it looks into it. Only blocks of several sets. Written."""

    def blocks(batches):
        for part in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array(block_entries(part, percent)[0])], names=["k"])

    listed = nodes.select("n", "size", "prefix")
    several = written(listed.mapInArrow(blocks, "k long").groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select(F.col("k").alias("__k")), "several")
    sent = nodes.sparkSession.sparkContext.broadcast(bit_filter(several))

    def run(batches):
        bits = sent.value
        for part in sliced(batches):
            k, row, at, own, look = block_entries(part, percent)
            keep = held(bits, k)
            parts = [k[keep], part.column(0).to_numpy()[row[keep]], part.column(1).to_numpy()[row[keep]], at[keep].astype(np.int32), own[keep], look[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["k", "n", "size", "at", "own", "look"])

    entries = listed.mapInArrow(run, "k long, n long, size int, at int, own boolean, look boolean")
    out = written(entries.join(several, F.col("k") == F.col("__k"), "left_semi"), "index-lists")
    sent.destroy()
    dropped(several)
    return out


def can_link(percent: int) -> Column:
    """Whether an entry (size, at) and another one (size_b, at_b) of a list can be of linked sets."""
    low = lambda s: F.floor((F.col(s).cast("long") * percent + 99) / 100)
    high = lambda s, at: F.floor((F.col(s).cast("long") - F.col(at)) * (100 + percent) / percent) - F.col(s)
    fits = lambda s, at, other: (F.col(other) >= low(s)) & (F.col(other) <= high(s, at))
    return fits("size", "at", "size_b") & fits("size_b", "at_b", "size")


def shared_enough(overlap: str, percent: int, a: str = "size_a", b: str = "size_b") -> Column:
    return F.col(overlap).cast("long") * (100 + percent) >= (F.col(a).cast("long") + F.col(b)) * percent


def with_roots(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return entries.withColumn("root", F.col("n"))
    own = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return entries.join(own, F.col("n") == F.col("__node"), "left").select(*entries.columns, F.coalesce("__root", "n").alias("root"))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose sketches leave room for the similarity. a, b, size_a, size_b. Written."""
    few = plausible(pairs, nodes.select(F.col("n").alias("id"), "size", "sketch"), Fraction(percent, 100))
    one, two = (nodes.select(F.col("n").alias(f"n_{k}"), F.col("size").alias(f"size_{k}")) for k in "ab")
    return written(few.join(one, F.col("a") == F.col("n_a")).join(two, F.col("b") == F.col("n_b")).select("a", "b", "size_a", "size_b"), "likely")


def apart(a: str, b: str) -> Column:
    """Bits that two short sketches differ in: no more than the sets have members apart."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(8)), F.lit(0))


def room(a: str, b: str, percent: int) -> Column:
    return F.floor((F.col(a).cast("long") + F.col(b)) * (100 - percent) / (100 + percent))


def leader_pairs(entries: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs a (a set), b (its leader): the leaders of a block are the sets of the least hashes in it; a set takes the few that most of the blocks it looks into have.

    So there are TRIES times the sets at most, however large a group is. In the first turn each set takes one.
    """
    tries = TRIES if turn else 1
    chosen = [F.min_by(F.struct("n", "size", "at", "root"), F.struct(F.xxhash64(F.lit(TRIES * turn + j), "n"), "n")) for j in range(tries)]
    leaders = written(entries.where("own").groupBy(F.col("k").alias("__k")).agg(F.array(*chosen).alias("b")), "leaders")
    met = entries.where("look").join(leaders, F.col("k") == F.col("__k")).select("n", "size", "at", "root", F.explode(F.array_distinct("b")).alias("b"))
    met = met.select("n", "size", "at", "root", *(F.col(f"b.{c}").alias(f"{c}_b") for c in ("n", "size", "at", "root")))
    votes = met.where((F.col("root") != F.col("root_b")) & can_link(percent)).groupBy("n", "n_b").agg(F.count("*").alias("votes"))
    place = F.row_number().over(W.partitionBy("n").orderBy(F.desc("votes"), F.xxhash64(F.lit(turn), "n_b"), "n_b"))
    out = written(votes.withColumn("place", place).where(F.col("place") <= tries).select(F.col("n").alias("a"), F.col("n_b").alias("b")), "leader-pairs")
    dropped(leaders)
    return out


def open_pairs(entries: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs a, b in a block of a list that are in different groups still. A block's largest group meets only the sets outside it; sketches let through few pairs that aren't similar. Written."""
    sizes = entries.groupBy("k", "root").agg(F.count("*").alias("c"))
    main = written(sizes.groupBy("k").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select(F.col("k").alias("__k"), "main"), "main-groups")
    kept = entries.join(main, F.col("k") == F.col("__k")).join(nodes.select(F.col("n").alias("__n"), "short"), F.col("n") == F.col("__n"))
    kept = written(kept.select(*entries.columns, "main", "short"), "open-entries")
    other = kept.where("own").select(*(F.col(c).alias(f"{c}_b") for c in ("k", "n", "size", "at", "root", "main", "short")))
    alike = (F.col("k") == F.col("k_b")) & (F.col("root") != F.col("root_b")) & can_link(percent) & (apart("short", "short_b") <= room("size", "size_b", percent))
    met = [kept.where("look").join(other.where("root_b <> main_b"), alike), kept.where("look and root <> main").join(other.where("root_b = main_b"), alike)]
    pairs = [m.select(F.least("n", "n_b").alias("a"), F.greatest("n", "n_b").alias("b")) for m in met]
    out = written(pairs[0].union(pairs[1]).distinct(), "open-pairs")
    dropped(main, kept)
    return out


def overlaps(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """pairs with o, how many members the sets a and b share. Only these nodes' sets are formed. Written."""
    ends = pairs.select(F.col("a").alias("__n")).union(pairs.select("b")).distinct()
    own = written(nodes.select("n", "hi", "lo", "first").join(ends, F.col("n") == F.col("__n"), "left_semi"), "compared-nodes")
    sets = sets_of(docs, own, shingle)
    one, two = (sets.select(F.col("n").alias(f"__{k}"), F.col("set").alias(f"set_{k}")) for k in "ab")
    met = pairs.join(one, F.col("a") == F.col("__a")).select(*pairs.columns, "set_a").join(two, F.col("b") == F.col("__b"))
    out = written(met.select(*pairs.columns, F.size(F.array_intersect("set_a", "set_b")).alias("o")), "overlaps")
    dropped(own, sets)
    return out


def bounded(pairs: DataFrame, led: DataFrame, share: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pairs (a, b, size_a, size_b) with the least and most members that they can share, from what their leaders share. Written.

    led: n, leader, more, fewer (members that n has and its leader has not, and the other way round). A set without a leader leads
    itself. share adds o, what sets a and b share, to pairs of leaders, and writes them.
    """
    of = lambda k: led.select(F.col("n").alias(f"n_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in ("leader", "more", "fewer")))
    both = lambda c: (F.coalesce(f"{c}_a", F.lit(0)) + F.coalesce(f"{c}_b", F.lit(0))).alias(c)
    met = pairs.join(of("a"), F.col("a") == F.col("n_a"), "left").join(of("b"), F.col("b") == F.col("n_b"), "left")
    met = written(met.select("a", "b", "size_a", "size_b", F.coalesce("leader_a", "a").alias("x"), F.coalesce("leader_b", "b").alias("y"), both("more"), both("fewer")), "led-pairs")
    answers = share(met.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    out = met.join(answers.select(F.col("a").alias("__x"), F.col("b").alias("__y"), "o"), (F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y")))
    out = written(out.select("a", "b", "size_a", "size_b", (F.col("o") - F.col("fewer")).alias("least"), (F.col("o") + F.col("more")).alias("most")), "bounded")
    dropped(met, answers)
    return out


def similar_sets(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles (members of the row's set) and component_id (the least doc_id that links reach) of each row of docs.

    Rows link if their sets share percent of their union at least; equal sets do. Null, empty and wordless texts have the empty
    set and link with nothing: component_id is their own doc_id. Texts with fewer words than a shingle have one, of all their
    words. A null doc_id counts for no component_id, which is null where all are. Repeated rows stay, with the same values.
    An empty table gives an empty result; other columns are not read. percent is below 100.
    """
    ready(docs.sparkSession)
    prints = prints_of(docs, shingle, Fraction(percent, 100))
    merged = prints.where("size > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), *(F.first(c, True).alias(c) for c in ("short", "sketch", "prefix")))
    # Numbered as they are written: from here on a set's number stays.
    nodes = written(merged.withColumn("n", F.monotonically_increasing_id()), "set-nodes")
    lists = index_lists(nodes, percent)
    some = written(nodes.drop("prefix").join(lists.select(F.col("n").alias("__n")).distinct(), F.col("n") == F.col("__n"), "left_semi"), "listed-nodes")
    listed, roots, led = some.count(), None, None

    def linked(links: DataFrame) -> int:
        """Takes the links a, b (written) into roots; how many there are."""
        nonlocal roots
        count = links.count()
        if roots is None or count:
            every = links if roots is None else links.union(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
            before, roots = roots, written(components(every, compression="none"), "set-roots")
            dropped(*([before] if before is not None else []))
        dropped(links)
        return count

    def share(pairs: DataFrame) -> DataFrame:
        return overlaps(pairs, docs, some, shingle)

    def by_leaders(pairs: DataFrame) -> int:
        """Links those of the pairs (written) that are similar: by their leaders' bounds where these tell, else by intersection."""
        if pairs.isEmpty():
            dropped(pairs)
            return 0
        known = bounded(pairs, led, share)
        sure = known.where(shared_enough("least", percent)).select("a", "b")
        rest = written(known.where(~shared_enough("least", percent) & shared_enough("most", percent)).select("a", "b", "size_a", "size_b"), "undecided")
        if rest.isEmpty():
            links = written(sure, "set-links")
        else:
            answers = share(rest)
            links = written(sure.union(answers.where(shared_enough("o", percent)).select("a", "b")), "set-links")
            dropped(answers)
        dropped(known, pairs, rest)
        return linked(links)

    first = leader_pairs(with_roots(lists, None), 0, percent)
    near = likely(first, some, percent)
    answers = share(near)
    alike = answers.where(shared_enough("o", percent))
    led = written(alike.select(F.col("a").alias("n"), F.col("b").alias("leader"), (F.col("size_a") - F.col("o")).alias("more"), (F.col("size_b") - F.col("o")).alias("fewer")), "led")
    new = linked(written(alike.select("a", "b"), "set-links"))
    dropped(first, near, answers)
    for turn in range(1, TURNS):
        if new < FEW * listed:
            break
        pairs = leader_pairs(with_roots(lists, roots), turn, percent)
        new = by_leaders(likely(pairs, some, percent))
        dropped(pairs)
    rest = open_pairs(with_roots(lists, roots), some, percent)
    by_leaders(likely(rest, some, percent))
    dropped(rest)
    dropped(lists, some, led)
    member = written(with_roots(nodes.select("n", "hi", "lo", "first"), roots), "set-members")
    least = written(member.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "__root"), "set-least")
    named = written(member.join(least, F.col("root") == F.col("__root")).select(F.col("hi").alias("__hi"), F.col("lo").alias("__lo"), "component_id"), "set-named")
    dropped(nodes, roots, member, least)
    rows = prints.select("doc_id", "hi", "lo", F.col("size").cast("long").alias("n_shingles"))
    placed = rows.join(named, (F.col("hi") == F.col("__hi")) & (F.col("lo") == F.col("__lo")), "left")
    return placed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: three-word shingles, links from 90 percent. Odd rows as in similar_sets()."""
    return similar_sets(documents(spark, sf_dir))


def op11_sql() -> str:
    return r"""WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    grams AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 2, least(len(w), 1)))) AS i) WHERE len(w) > 0),
    sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
    shared AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
    links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes s ON a = s.doc_id JOIN sizes t ON b = t.doc_id WHERE 100 * o >= 90 * (s.n + t.n - o)),
    edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN edges l ON r.b = l.a)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.b) AS component_id FROM documents d JOIN reached r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY 1, 2"""
