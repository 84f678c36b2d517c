"""Groups of texts whose word shingles are similar: SimHash deletion variants first, an exact prefix filter for the rest.

Texts link if the sets of their word shingles have a given similarity (Jaccard) or more. Fingerprints alone can't decide
that: at a similarity of 0.8 they differ in more bits than any index of deletion variants reaches. So they only propose
pairs, and every pair is verified on the sets. What they miss is found by a prefix filter, which is exact: in an order
of all shingles (those that many texts have come last), similar sets share one of the first shingles of each, so they
meet under its key by an equality join. A pair is left unverified only if other links have both in one group already.

1. One pass makes each text's set, its fingerprint and its prefix. Equal sets are one node from here on.
2. Keys that two nodes have are kept; nodes without such a key are alone and cost nothing more.
3. Pairs of nodes with linked fingerprints, and pairs of a node and the centre of most of its keys, are verified at once, and groups are formed.
4. Under each key, nodes are compared with other centres, and the groups are formed anew; again while that links many.
5. All pairs under a key that are in different groups still are compared; a key's largest group meets only those outside it.

To verify pairs, first their parity sketches are compared (a bit for each cell of hashes, whether it holds an odd number of
the set's members): two sketches differ in no more bits than the sets have members apart, so a pair that differs in more
bits than the similarity leaves room for is none, exactly. What is left, few pairs but similar ones, is joined to the sets
of just these nodes, and the JVM intersects them.

Fixed-size bit filters keep rows that can't match from being shuffled; false positives are removed by exact joins.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import dropped, ready
from .components import components
from .shingles import lots, window_hashes
from .simhash import SEED, fingerprint_links

#: Every how many-th document (by hash) tells how common shingles are. That only orders shingles: results are exact in any order.
EVERY = 16
#: Cells of the table of how common shingles are, and bits of a filter. Both sizes are fixed.
CELLS, BITS = 1 << 22, 1 << 26
#: Turns in which nodes are compared with centres at most, centres of a key in a turn, and the share of nodes that a turn must link for another one to follow.
TURNS, TRIES, FEW = 3, 4, 0.01
#: Bits that fingerprints of proposed pairs may differ in.
DISTANCE = 3


#: Nodes whose prefixes are handled at a time.
SLICE = 512


def written(df: DataFrame, label: str) -> DataFrame:
    """As common.written(). Many small tables of hashes: compressors would hold memory outside the heap for each of their files, and gain little."""
    return common.written(df, label, "none")


def set_id(values: np.ndarray) -> int:
    """One signed long for equal sets."""
    return xxhash.xxh64_intdigest(values.tobytes(), SEED) - (1 << 63)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits, as a signed long, that over half of the hashes have."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 255):  # in runs that a byte can count
        votes += np.unpackbits(hashes[k : k + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0]) if len(hashes) else 0


def how_common(docs: DataFrame, shingle: int) -> np.ndarray:
    """For each cell of shingles' hashes, the logarithm of how many of the sampled documents the commonest has."""

    def run(batches):
        for batch in batches:
            for _, texts in lots(batch.column(0)):
                sets = [np.unique(h) for h in window_hashes(texts, shingle)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["key"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(EVERY)) == 0).select("text")
    seen = sample.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cell, level = F.shiftrightunsigned("key", 42).cast("int"), F.floor(F.log2("n")).cast("byte")
    top = seen.groupBy(cell.alias("cell")).agg(F.max(level).alias("level")).toArrow()
    out = np.zeros(CELLS, np.uint8)
    out[top.column("cell").to_numpy()] = top.column("level").to_numpy()
    return out


def prefix(values: np.ndarray, common: np.ndarray, least: Fraction) -> np.ndarray:
    """The first shingles of a set in the order of all (less common cells first, then by hash): two sets that are similar enough share one of them."""
    order = np.argsort(common[values >> np.uint64(42)], kind="stable")
    return values[order[: len(values) - math.ceil(least * len(values)) + 1]] if len(values) else values


def sketch(values: np.ndarray) -> bytes:
    """The parity of the number of members in each of at least 64 cells, about as many cells (a power of two) as members."""
    cells = 1 << max(6, (len(values) - 1).bit_length())
    odd = np.bincount((values >> np.uint64(20) & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def short_sketch(values: np.ndarray) -> np.ndarray:
    """The same over 512 cells for all sets, as eight longs."""
    odd = np.bincount((values >> np.uint64(20) & np.uint64(511)).astype(np.int64), minlength=512).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def room(size: str, other: str, least: Fraction) -> Column:
    """Members that sets of these sizes may have apart at most."""
    return F.floor((F.col(size) + F.col(other)) * (least.denominator - least.numerator) / (least.denominator + least.numerator))


def folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Sketches (one a row) over fewer cells: those that fall together are added up."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def row_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def prints_of(docs: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """doc_id, row (hash of the text), id (of the set), size, fp, sketches and prefix of each row of docs. Written."""
    sent = docs.sparkSession.sparkContext.broadcast(how_common(docs, shingle))

    def run(batches):
        common = sent.value
        for batch in batches:
            for begin, texts in lots(batch.column(2)):
                hashes = window_hashes(texts, shingle)
                sets = [np.unique(h) for h in hashes]
                firsts = [prefix(s, common, least).view(np.int64) for s in sets]
                ends = np.r_[0, np.cumsum([len(f) for f in firsts])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))
                own = [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([majority(h) for h in hashes], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([short_sketch(s) for s in sets], pa.list_(pa.int64())), lists]
                rows = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *own], names=["doc_id", "row", "id", "size", "fp", "sketch", "short", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long"), row_hash().alias("row"), "text")
    out = written(rows.mapInArrow(run, "doc_id long, row long, id long, size int, fp long, sketch binary, short array<long>, prefix array<long>"), "prefixes")
    sent.destroy()
    return out


def bit_filter(values: DataFrame) -> np.ndarray:
    """BITS bits, as bytes, that the values of a single long column have set. Its size is fixed."""
    bit = values.select(F.pmod(F.col(values.columns[0]), F.lit(BITS)).alias("bit"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in bit.groupBy(F.floor(F.col("bit") / 32768).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(32768))).alias("bits")).collect():
        out[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def held(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values (signed longs) have their bit set."""
    at = values % BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def meeting(prints: DataFrame) -> DataFrame:
    """key, id, size, at (place in the prefix) of each node, for keys that several nodes have."""
    keys = prints.select("id", F.explode("prefix").alias("key")).groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    several = written(keys.where("low <> high").select("key"), "several")
    sent = prints.sparkSession.sparkContext.broadcast(bit_filter(several))

    def run(batches):
        bits, known = sent.value, set()
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            ids, sizes, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            # One row of each set is enough; a task remembers so many that it has sent.
            new = np.ones(len(ids), bool)
            for k, i in enumerate(ids.tolist()):
                new[k] = i not in known
                known.add(i)
            known = known if len(known) < 20_000 else set()
            counts = lists.value_lengths().to_numpy()
            keys, node = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), counts)
            at = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
            keep = new[node] & held(bits, keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(ids[node[keep]]), pa.array(sizes[node[keep]]), pa.array(at[keep].astype(np.int32))], names=["key", "id", "size", "at"])

    rows = prints.select("id", "size", "prefix").mapInArrow(run, "key long, id long, size int, at int").distinct()
    out = written(rows.join(several.withColumnRenamed("key", "__key"), F.col("key") == F.col("__key"), "left_semi"), "meeting")
    sent.destroy()
    dropped(several)
    return out


def may_match(least: Fraction) -> Column:
    """Whether a pair that shares a shingle at given places of the order can reach the similarity: sizes alike, and enough shingles left.

    The pair's first shared shingle passes if the pair is similar: what it shares is at or after that.
    """
    num, den = least.numerator, least.denominator
    sizes = (F.col("size") * den >= F.col("size_b") * num) & (F.col("size_b") * den >= F.col("size") * num)
    left = F.least(F.col("size") - F.col("at"), F.col("size_b") - F.col("at_b"))
    return sizes & (left * (num + den) >= (F.col("size") + F.col("size_b")) * num)


def with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("id"))
    own = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.join(own, F.col("id") == F.col("__node"), "left").select(*rows.columns, F.coalesce("__root", "id").alias("root"))


def pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs a, b of nodes (id, fp) that equal fingerprints, or links between different ones, propose."""
    first = written(nodes.groupBy("fp").agg(F.min("id").alias("rep")), "print-reps")
    links = written(fingerprint_links(first.select("fp"), DISTANCE), "print-links")
    rep = lambda n: first.select(F.col("fp").alias(f"fp_{n}"), F.col("rep").alias(f"rep_{n}"))
    equal = nodes.join(rep("a"), F.col("fp") == F.col("fp_a")).where("id <> rep_a").select(*pair("id", "rep_a"))
    other = links.join(rep("a"), F.col("a") == F.col("fp_a")).join(rep("b"), F.col("b") == F.col("fp_b")).select(*pair("rep_a", "rep_b"))
    out = written(equal.union(other).distinct(), "print-pairs")
    dropped(first, links)
    return out


def star_pairs(rows: DataFrame, turn: int, least: Fraction) -> DataFrame:
    """Pairs a, b: each node with a few others, those that most of its keys have as their centres (nodes of the least hashes under the key).

    So there are no more pairs than TRIES times the nodes, however large a group is. Turns choose other centres; the first
    takes one for each key, later ones pass over keys of two nodes, which the first has seen.
    """
    tries = TRIES if turn else 1
    chosen = [F.min_by(F.struct("id", "size", "at", "root"), F.struct(F.xxhash64(F.lit(TRIES * turn + j), "id"), "id")) for j in range(tries)]
    centres = rows.groupBy("key").agg(F.array(*chosen).alias("b"), F.count("*").alias("n")).where(F.col("n") > (2 if turn else 1))
    centres = written(centres.select(F.col("key").alias("__key"), "b"), "centres")
    met = rows.join(centres, F.col("key") == F.col("__key")).select("id", "size", "at", "root", F.explode(F.array_distinct("b")).alias("b"))
    met = met.select("id", "size", "at", "root", *(F.col(f"b.{c}").alias(f"{c}_b") for c in ("id", "size", "at", "root")))
    votes = met.where((F.col("root") != F.col("root_b")) & may_match(least)).groupBy("id", "id_b").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), F.xxhash64(F.lit(turn), "id_b"), "id_b"))
    out = written(votes.withColumn("place", place).where(F.col("place") <= tries).select(*pair("id", "id_b")).distinct(), "star-pairs")
    dropped(centres)
    return out


def open_pairs(rows: DataFrame, nodes: DataFrame, least: Fraction) -> DataFrame:
    """All pairs a, b under a key that are not in the same group yet. A key's largest group meets only those outside it, and the short sketches let through few pairs that aren't similar."""
    sizes = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = written(sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select(F.col("key").alias("__key"), "main"), "main-groups")
    kept = rows.join(most, F.col("key") == F.col("__key")).join(nodes.select(F.col("id").alias("__id"), "short"), F.col("id") == F.col("__id"))
    kept = written(kept.select("key", "id", "size", "at", "root", "main", "short"), "open")
    other = kept.where("root <> main").select(*(F.col(c).alias(f"{c}_b") for c in ("key", "id", "size", "at", "root", "short")))
    apart = sum((F.bit_count(F.col("short")[k].bitwiseXOR(F.col("short_b")[k])) for k in range(8)), F.lit(0))
    new = (F.col("root") != F.col("root_b")) & ((F.col("root") == F.col("main")) | (F.col("id") < F.col("id_b")))
    met = kept.join(other, (F.col("key") == F.col("key_b")) & new & may_match(least) & (apart <= room("size", "size_b", least)))
    out = written(met.select(*pair("id", "id_b")).distinct(), "open-pairs")
    dropped(most, kept)
    return out


def candidate_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """id, set (array of hashes) of the nodes (id, first). Bit filters of fixed size keep most other sets from the shuffle. Written."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((bit_filter(nodes.select("id")), bit_filter(nodes.where("first is not null").select("first"))))

    def run(batches):
        by_id, by_first = sent.value
        for batch in batches:
            own = batch.column(0)
            batch = batch.filter(pa.array(own.is_null().to_numpy(False) | held(by_first, own.fill_null(0).to_numpy())))
            for _, texts in lots(batch.column(1)):
                sets = [np.unique(h).view(np.int64) for h in window_hashes(texts, shingle)]
                ids = np.array([set_id(s) for s in sets], np.int64)
                keep = np.flatnonzero(held(by_id, ids))
                ends = np.r_[0, np.cumsum([len(sets[k]) for k in keep])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(sets[k] for k in keep)])))
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), lists], names=["id", "set"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id long, set array<long>")
    sets = rows.join(nodes.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_semi").groupBy("id").agg(F.first("set").alias("set"))
    out = written(sets, "sets")
    sent.destroy()
    return out


def plausible(pairs: DataFrame, nodes: DataFrame, least: Fraction) -> DataFrame:
    """The pairs a, b whose sketches leave room for the similarity."""
    num, den = least.numerator, least.denominator

    def run(batches):
        for batch in batches:
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            left = (batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy()) * (den - num) // (den + num)
            alike, keep = {}, np.zeros(len(one), bool)
            for k, (x, y) in enumerate(zip(one, two, strict=True)):
                alike.setdefault((len(x), len(y)), []).append(k)
            for (m, n), at in alike.items():
                x = np.frombuffer(b"".join(one[k] for k in at), np.uint8).reshape(-1, m)
                y = np.frombuffer(b"".join(two[k] for k in at), np.uint8).reshape(-1, n)
                apart = np.bitwise_count(folded(x, min(m, n)) ^ folded(y, min(m, n))).sum(axis=1, dtype=np.int64)
                keep[at] = apart <= left[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    one, two = (nodes.select(F.col("id").alias(f"id_{n}"), F.col("sketch").alias(f"sketch_{n}"), F.col("size").alias(f"size_{n}")) for n in "ab")
    met = pairs.join(one, F.col("a") == F.col("id_a")).join(two, F.col("b") == F.col("id_b"))
    return met.select("a", "b", "sketch_a", "sketch_b", "size_a", "size_b").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """The pairs a, b of nodes whose sets have at least this similarity, exactly. Written, as all tables on the way there."""
    pairs = written(plausible(pairs, nodes, least), "plausible")
    ends = pairs.select(F.col("a").alias("__id")).union(pairs.select("b")).distinct()
    own = written(nodes.select("id", "first").join(ends, F.col("id") == F.col("__id"), "left_semi"), "plausible-nodes")
    sets = candidate_sets(docs, own, shingle)
    one, two = (sets.select(F.col("id").alias(f"id_{n}"), F.col("set").alias(f"set_{n}")) for n in "ab")
    met = pairs.join(one, F.col("a") == F.col("id_a")).select("a", "b", "set_a").join(two, F.col("b") == F.col("id_b"))
    same, num, den = F.size(F.array_intersect("set_a", "set_b")), least.numerator, least.denominator
    out = written(met.where(same * (num + den) >= (F.size("set_a") + F.size("set_b")) * num).select("a", "b"), "similar")
    dropped(pairs, own, sets)
    return out


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, row (hash of the text), component_id (the least doc_id of the row's group) and stays of each row of docs.

    In each group one document stays: the one with the least doc_id, then row. A null doc_id comes after all others, and
    component_id is null where all are. Null, empty and wordless texts have the empty set and are one group. Texts with
    fewer words than a shingle have one shingle, of all their words. Rows that repeat both id and text are one document and
    stay or go together. An empty table gives an empty result; other columns are not read.
    """
    least = Fraction(str(similarity))
    ready(docs.sparkSession)
    prints = prints_of(docs, shingle, least)
    nodes = written(prints.groupBy("id").agg(F.min("doc_id").alias("first"), *(F.first(c).alias(c) for c in ("size", "fp", "sketch", "short"))), "prefix-nodes")
    shared = meeting(prints)
    some = written(nodes.join(shared.select(F.col("id").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left_semi"), "meeting-nodes")
    nodes_met = some.count()
    roots = None

    def linked(pairs: DataFrame) -> int:
        """Verifies pairs, dropping them, and takes the links into roots; how many links there are."""
        nonlocal roots
        new = verified(docs, pairs, some, shingle, least)
        count = new.count()
        if roots is None or count:
            # What is linked already stays so: each node and its root, and the new pairs.
            links = new if roots is None else new.union(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
            before, roots = roots, written(components(links, compression="none"), "similar-roots")
            dropped(*([before] if before is not None else []))
        dropped(pairs, new)
        return count

    # The first pairs are verified at once: another pass over the texts and another forming of groups would cost more than the few pairs that either spares the other.
    prints_met, stars = print_pairs(some.select("id", "fp")), star_pairs(with_roots(shared, None), 0, least)
    new = linked(written(prints_met.union(stars).distinct(), "first-pairs"))
    dropped(prints_met, stars)
    for turn in range(1, TURNS):
        if new < FEW * nodes_met:
            break
        new = linked(star_pairs(with_roots(shared, roots), turn, least))
    linked(open_pairs(with_roots(shared, roots), some, least))
    dropped(shared, some)
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")
    member = prints.select("doc_id", "row", "id").join(roots.withColumnRenamed("root", "__root"), F.col("id") == F.col("node"), "left").select("doc_id", "row", F.coalesce("__root", "id").alias("root"))
    member = written(member, "members")
    kept = written(member.groupBy("root").agg(F.min(place).alias("kept")).withColumnRenamed("root", "__root"), "kept")
    dropped(prints, nodes, roots)
    return member.join(kept, F.col("root") == F.col("__root")).select("doc_id", "row", F.col("kept.doc_id").alias("component_id"), (place == F.col("kept")).alias("stays"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, with its columns, less the documents that don't stay in their group of similar ones. Odd rows as in similar_groups()."""
    gone = similar_groups(docs, shingle, similarity).where(~F.col("stays")).select(F.col("doc_id").alias("__gone"), F.col("row").alias("__row")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("__gone")) & (row_hash() == F.col("__row")), "left_anti")
