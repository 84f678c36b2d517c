"""Near copies by SimHash, with an index of deletion variants.

A text's fingerprint takes each bit that over half of its word shingles' XXH64 values have set.
Two fingerprints link if they differ in few bits (max_distance). They are cut into so few segments that
in one of them such a pair differs by one bit at most (max_distance // 2 + 1 segments). For each segment
the index holds its exact value and each of its variants with one bit wildcarded; a pair that may link
meets under at least one key by an equality join, and is then verified on all its bits.

Equal fingerprints are grouped first, so exact copies never form pairs. Within a key, what is verified is
reduced to a star (at most one link less than members), so no group of copies emits all its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, dropped, partitions, ready, written
from .components import components

SEED = 42
#: Keys with more members than this are cut further before members are compared.
WIDE = 1024


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case. bytes.split() and bytes.lower() know ASCII only."""
    return text.encode().lower().split() if text else []


def shingle_hashes(words: list[bytes], size: int) -> list[int]:
    """XXH64 of each window of size words, repeats included; of all words if there are fewer."""
    if not words:
        return []
    line, n = b" ".join(words), max(1, len(words) - size + 1)
    at = [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    digest = xxhash.xxh64_intdigest
    return [digest(line[a : b - 1], SEED) for a, b in zip(at[:n], at[min(size, len(words)) :], strict=False)]


def majority(hashes: list[int]) -> int:
    """The 64 bits that over half of the hashes have; 0 if there are none."""
    if not hashes:
        return 0
    values, votes = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for k in range(0, len(values), 255):  # in runs that a byte can count
        votes += np.unpackbits(values[k : k + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) of each row of docs. Null and wordless texts have 0."""

    def run(batches):
        for batch in batches:
            fps = np.array([majority(shingle_hashes(words_of(t.as_py()), shingle)) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def index_keys(fp: str, max_distance: int) -> F.Column:
    """Array of keys: segment number, wildcarded bit (or none) and the segment's other bits, in one long."""
    count = max_distance // 2 + 1
    width, keys = 64 // count, []
    for s in range(count):
        low = s * width
        bits = width if s < count - 1 else 64 - low
        part = F.shiftrightunsigned(F.col(fp), low).bitwiseAND(F.lit((1 << bits) - 1))
        tag = lambda wild, part, s=s: F.xxhash64(F.lit(s * 65 + wild), part)
        keys += [tag(64, part)] + [tag(b, part.bitwiseAND(F.lit(((1 << bits) - 1) ^ (1 << b)))) for b in range(bits)]
    return F.array(*keys)


def _near(values: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs in the same group (contiguous) that differ in at most `most` bits."""
    left, right = [], []
    at, step = np.arange(len(values) - 1), 1
    while len(at := at[at + step < len(values)]) and len(at := at[group[at] == group[at + step]]):
        hit = at[np.bitwise_count(values[at] ^ values[at + step]) <= most]
        left.append(hit)
        right.append(hit + step)
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star of each connected part of n members: member, least member."""
    least = np.arange(n)
    while len(a):
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if np.array_equal(least[a], least[b]):
            break
    far = np.flatnonzero(least != np.arange(n))
    return far, least[far]


def linked(keys: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (values) between members of the same key. Large groups are cut into members that share one of most + 1 segments."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    group = np.repeat(np.arange(len(starts)), sizes)
    fits = np.repeat((sizes > 1) & (sizes <= WIDE), sizes)
    out = []
    v, g = values[fits], group[fits]
    if len(v):
        far, least = _stars(len(v), *_near(v, g, most))
        out.append((v[far], v[least]))
    for k in np.flatnonzero(sizes > WIDE):
        v = np.unique(values[starts[k] : starts[k] + sizes[k]])
        cuts = np.linspace(0, 64, most + 2).astype(int)
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            part = (v >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)
            by = np.argsort(part, kind="stable")
            far, least = _stars(len(v), *_near(v[by], part[by], most))
            out.append((v[by][far], v[by][least]))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *(x for x, _ in out)]), np.concatenate([none, *(x for _, x in out)])


def fingerprint_links(nodes: DataFrame, max_distance: int = 3) -> DataFrame:
    """nodes: distinct fp. Returns a, b: links whose components are those of all pairs within max_distance.

    Members of a key with more than WIDE of them are not compared at once: they meet again under sub-keys, one for each of
    max_distance + 1 pieces of the whole fingerprint, one of which any linked pair has alike. So no key holds a task up.
    """
    spark = nodes.sparkSession
    rows = nodes.count() * (64 + max_distance // 2 + 1)
    buckets = max(4 * partitions(spark), rows // 100_000 + 1)

    def compared(own: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
        a, b = linked(own, fps.view(np.uint64), max_distance)
        pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)]), axis=1)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1], "key": pd.array([None] * pairs.shape[1], "Int64")})

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        many = pdf.groupby("key")["key"].transform("size").to_numpy() > WIDE
        few, rest = pdf[~many], pdf[many]
        found = compared(few["key"].to_numpy(), few["fp"].to_numpy())
        return pd.concat([found, pd.DataFrame({"a": rest["fp"], "b": rest["fp"], "key": rest["key"].astype("Int64")})]) if len(rest) else found

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        return compared(pdf["key"].to_numpy(), pdf["fp"].to_numpy())[["a", "b"]]

    keyed = nodes.select("fp", F.explode(index_keys("fp", max_distance)).alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    found = written(keyed.groupBy("bucket").applyInPandas(first, "a long, b long, key long"), "fingerprint-links")
    wide, links = found.where("key is not null"), found.where("key is null").select("a", "b")
    if wide.isEmpty():
        return links
    cuts = np.linspace(0, 64, max_distance + 2).astype(int).tolist()
    piece = lambda low, high: F.shiftrightunsigned(F.col("a"), low).bitwiseAND(F.lit((1 << (high - low)) - 1))
    subs = F.array(*(F.xxhash64("key", F.lit(j), piece(low, high)) for j, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))))
    parts = wide.select(F.col("a").alias("fp"), F.explode(subs).alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    return links.union(parts.groupBy("bucket").applyInPandas(again, "a long, b long"))


def near_copies(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, itself included) of each row of docs.

    Null text: no words, fingerprint 0, which links like any other. Null doc_id: counts for no
    component_id, which is null where all are. Repeated rows stay, with the same values. An empty table
    gives an empty result. Other columns of docs are not read.
    """
    ready(docs.sparkSession)
    prints = written(fingerprints(docs, shingle), "simhash")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = written(first, "simhash-nodes")
    roots = components(fingerprint_links(nodes.select("fp"), max_distance))
    member = written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-members")
    # Written first: then both sides of the join are plain shuffles, and Spark splits the root of a very large component.
    least = written(member.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "__root"), "simhash-least")
    named = written(member.join(least, F.col("root") == F.col("__root")).select(F.col("fp").alias("node"), "component_id"), "simhash-named")
    dropped(nodes, member, least)
    return prints.join(named, prints["fp"] == named["node"]).select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every document; odd rows as in near_copies()."""
    found = near_copies(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
