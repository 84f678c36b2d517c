"""Canonical exact digests: equal up to Unicode form, case and white space.

canonical() turns a text into its compatibility decomposition with folded case, canonical order of marks and
single spaces. The fingerprint is 128 bits of xxhash over it. Within equal fingerprints the canonical bytes
are compared with those of the first document; should any differ, those get a fingerprint of their own.

Everything is column expressions and joins; no Python runs on executors. Tables of characters are made by
rule from Python's unicodedata and have a fixed size.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, documents, let, partitions, written

#: Groups of copies up to this number reach executors by broadcast (16 bytes each), more by a shuffle.
BROADCAST_GROUPS = 500_000
#: White space that decomposition leaves (other kinds become plain spaces), but for the space itself.
SPACES = r"\x09-\x0D\x1C-\x1F\x85\x{1680}\x{2028}\x{2029}"
SEP = "\x01"


def fold(c: str) -> str:
    """Compatibility decomposition of a character in lower case."""
    return unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", c).lower())


@lru_cache(maxsize=1)
def folding() -> tuple[list[int], list[str]]:
    """For each 256-character page its place in the list of characters' foldings, -1 for a page that nothing changes in."""
    places, flat = [], []
    for page in range(0x110000 >> 8):
        chars = [chr(c) if not 0xD800 <= c < 0xE000 else "" for c in range(page << 8, (page + 1) << 8)]
        folds = [fold(c) for c in chars]
        places.append(len(flat) if folds != chars else -1)
        flat += (folds if page else [""] * 128 + folds[128:]) if places[-1] >= 0 else []
    return places, flat


@lru_cache(maxsize=1)
def mark_classes() -> tuple[str, list[int]]:
    """The characters with a combining class, and their classes."""
    marks = [chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    return "".join(marks), [unicodedata.combining(c) for c in marks]


@lru_cache(maxsize=1)
def compositions() -> list[tuple[str, str]]:
    """For each character of mark_classes() the letters that it composes with, and what they become."""
    pairs: dict[str, tuple[str, str]] = {}
    for c in map(chr, range(0xC0, 0x20000)):
        parts = unicodedata.normalize("NFD", c) if unicodedata.decomposition(c) and "<" not in unicodedata.decomposition(c) else ""
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == c and unicodedata.combining(parts[-1]):
            base = unicodedata.normalize("NFC", parts[:-1])
            if len(base) == 1:
                old, new = pairs.get(parts[-1], ("", ""))
                pairs[parts[-1]] = (old + base, new + c)
    return [pairs.get(m, ("", "")) for m in mark_classes()[0]]


@lru_cache(maxsize=1)
def stable() -> set[str]:
    """Characters whose texts need nothing but lower(): no marks, and what they fold to is one character with marks composed."""
    made = {(b, m): t for m, (old, new) in zip(mark_classes()[0], compositions(), strict=True) for b, t in zip(old, new, strict=True)}

    def composed(text: str) -> str:
        out = text[:1]
        for m in text[1:]:
            out = made.get((out, m), out + m)
        return out

    chars = (chr(c) for c in range(0xD800))
    return {c for c in chars if not unicodedata.combining(c) and len(c.lower()) == 1 and composed(fold(c)) == c.lower()}


def pattern_class(chars: set[str], start: str = "[") -> str:
    """A class of a regular expression with these characters."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return start + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in out) + "]"


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(SEP.join(map(str, values))), SEP).cast("array<int>")


def _texts(values: list[str]) -> Column:
    return F.split(F.lit(SEP.join(values)), SEP)


def _recomposed(cluster: Column) -> Column:
    """A character and its marks: the marks in canonical order, each composed with the character where that is possible."""
    marks, classes = mark_classes()
    table = lambda values, mark: F.element_at(values, F.call_function("instr", F.lit(marks), mark))
    split = F.regexp_extract_all(cluster, F.lit("(?s)."), F.lit(0))
    ordered = F.array_sort(F.transform(F.slice(split, 2, F.size(split)), lambda c, i: F.struct(table(_numbers(classes), c).alias("class"), i.alias("i"), c.alias("c"))))
    olds, news = _texts([o for o, _ in compositions()]), _texts([n for _, n in compositions()])

    def add(s: Column, m: Column) -> Column:
        tried = F.call_function("translate", s["base"], table(olds, m["c"]), table(news, m["c"]))
        ok = (tried != s["base"]) & (s["last"] < m["class"])
        return F.struct(F.when(ok, tried).otherwise(s["base"]).alias("base"), F.when(ok, s["rest"]).otherwise(F.concat(s["rest"], m["c"])).alias("rest"), F.when(ok, s["last"]).otherwise(m["class"]).alias("last"))

    start = F.struct(F.element_at(split, 1).alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    return F.aggregate(ordered, start, add, lambda s: F.concat(s["base"], s["rest"]))


def _normalised(text: Column) -> Column:
    """The long way, for texts with characters that are not stable()."""
    places, flat = folding()
    page = lambda code: F.element_at(_numbers(places), (F.shiftright(code, 8) + 1).cast("int"))
    entry = lambda c, code: let(page(code), lambda p: F.when(p < 0, c).otherwise(F.element_at(_texts(flat), (p + code % 256 + 1).cast("int"))))
    folded = lambda c: let(F.ascii(c), lambda code: F.when(code < 128, F.lower(c)).otherwise(entry(c, code)))
    mark, unmarked = (pattern_class(set(mark_classes()[0]), begin) for begin in ("[", "[^"))
    pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    # A character with its marks, or a run without any. Single classes are repeated, never groups: those recurse once a character.
    clusters = lambda t: F.regexp_extract_all(t, F.lit(f"(?s){unmarked}+(?!{mark})|.{mark}*"), F.lit(0))
    marked = lambda c: F.when(F.substring(c, 2, 1).rlike(mark), _recomposed(c)).otherwise(c)
    return let(F.array_join(F.transform(pieces, folded), ""), lambda t: F.when(t.rlike(mark), F.array_join(F.transform(clusters(t), marked), "")).otherwise(t))


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty. Texts of stable characters alone only need lower case."""
    text = F.coalesce(text, F.lit(""))
    latin = pattern_class({c for c in stable() if c < "Ā"}, "[^")
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike(latin) | ~text.rlike(pattern_class(stable(), "[^"))
    folded = F.when(plain, F.lower(text)).otherwise(_normalised(text))
    return F.trim(F.regexp_replace(folded, f"[ {SPACES}]{{2,}}|[{SPACES}]", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits as 32 hexadecimal digits: xxhash64, and xxhash64 that goes on from another value's hash."""
    part = lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))
    return F.concat(part(F.xxhash64(canon)), part(F.xxhash64(F.lit("second half"), canon)))


def fingerprint(text: Column) -> Column:
    return let(canonical(text), wide_hash)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, row_hash (of the text), fingerprint, with byte comparison inside equal fingerprints.

    Null texts count as empty. Repeated rows stay. Empty tables give empty results; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), fingerprint(F.col("text")).alias("fp"))
    prints = written(rows, "digests")
    return _told_apart(docs, prints).withColumnRenamed("fp", "fingerprint")


def _told_apart(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """prints (doc_id, row_hash, fp and more) with another fp for rows whose canonical bytes differ from the first of their bucket."""
    odd = _odd(docs, prints)[0]
    if odd.isEmpty():
        return prints
    same = (F.coalesce(prints["doc_id"], F.lit(NULL_ID)) == odd["id"]) & (prints["row_hash"] == odd["row"])
    return prints.join(odd, same, "left").withColumn("fp", _apart("fp")).drop("id", "row", "other")


def _apart(fp: str) -> Column:
    return F.when(F.col("other").isNotNull(), F.concat_ws("-", fp, "other")).otherwise(F.col(fp))


def _odd(docs: DataFrame, prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, row) whose canonical bytes differ from those of the first of their bucket, with a digest of these bytes as other; and the first's bytes of each bucket (own, model).

    Only texts whose hash is that of a member of a bucket are brought into canonical form again.
    """
    buckets = prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.coalesce("doc_id", F.lit(NULL_ID))).alias("first")).where("n > 1").select(F.col("fp").alias("bucket"), "first")
    buckets = written(buckets, "buckets")
    hashes = written(prints.select("fp", "row_hash").distinct().join(buckets, F.col("fp") == F.col("bucket")).select(F.col("row_hash").alias("member"), "bucket", "first"), "bucket-members")
    if hashes.count() <= BROADCAST_GROUPS:
        hashes = F.broadcast(hashes)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), "text")
    members = written(texts.join(hashes, F.col("row") == F.col("member")).select("id", "row", "bucket", "first", canonical(F.col("text")).alias("canon")), "members")
    firsts = written(members.where("id = first").groupBy("bucket").agg(F.min("canon").alias("model")).withColumnRenamed("bucket", "own"), "models")
    odd = members.select("id", "row", "bucket", "canon").join(firsts, F.col("bucket") == F.col("own")).where("canon <> model")
    return written(odd.select("id", "row", F.sha2("canon", 256).alias("other")).distinct(), "odd"), firsts


def block_of(value: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are at most the value, by binary search."""
    table = F.split(F.lit(",".join(map(str, splits))), ",").cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(len(splits) + 1)))))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = (s["low"] < s["high"]) & (F.element_at(table, F.least(mid + 1, F.lit(len(splits)))) <= value)
        return F.struct(F.when(right, mid + 1).otherwise(s["low"]).alias("low"), F.when(right | (s["low"] >= s["high"]), s["high"]).otherwise(mid).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(splits)).alias("high")), step, lambda s: s["low"]) if splits else F.lit(0)


def with_next(rows: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """rows (with a long column id, never null) and next_<c> for each carried column, from the row that follows by order (id first); the first follows the last.

    Rows go once to blocks of ids that hold about equally many; the first row of each block is also sent to
    the block before, so no task sees more than its block.
    """
    spark = rows.sparkSession
    count = 4 * partitions(spark)
    ends = rows.agg(F.min("id").alias("least"), F.percentile_approx("id", F.array(*(F.lit(k / count) for k in range(1, count))), F.lit(10 * count)).alias("splits")).first()
    if ends["least"] is None:
        return rows.select("*", *(F.col(c).alias(f"next_{c}") for c in carried))
    splits = sorted({s for s in ends["splits"] if s > ends["least"]})
    block = F.col("__block")
    starts = F.array_contains(F.split(F.lit(",".join(map(str, splits)) or str(ends["least"])), ",").cast("array<bigint>"), F.col("id"))
    place = lambda b, real, turn: F.struct(b.cast("int").alias("block"), F.lit(real).alias("real"), F.lit(turn).alias("turn"))
    places = F.array_compact(F.array(place(block, True, 0), F.when((block > 0) & starts, place(block - 1, False, 0)), F.when(F.col("id") == ends["least"], place(F.lit(len(splits)), False, 1))))
    dealt = rows.withColumn("__block", block_of(F.col("id"), splits)).withColumn("__at", F.explode(places)).drop("__block")
    after = W.partitionBy("__at.block").orderBy("__at.turn", *order)
    return dealt.select("*", *(F.lead(c).over(after).alias(f"next_{c}") for c in carried)).where("__at.real").drop("__at")


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(length / 2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def op2_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, the digests of every document and of its edited text, and how like they are to it and to the next's.

    Likeness is that of canonical bytes: where two fingerprints are equal, the bytes decide. Odd rows as in fingerprints().
    """
    docs = documents(spark, sf_dir)
    prints = written(_with_edited(docs), "digests")
    odd, models = _odd(docs, prints)
    told = prints if odd.isEmpty() else _edited_told_apart(docs, prints, odd, models)
    return told.select("doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")


def _pairs(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("row_hash"), fingerprint(F.col("text")).alias("fp"))
    return with_next(rows, ["id", "row_hash"], ["text", "fp"]).withColumn("edited", edited(F.col("text"), F.col("next_text")))


def _with_edited(docs: DataFrame) -> DataFrame:
    changed = _pairs(docs).withColumn("edited_fp", fingerprint(F.col("edited")))
    alike = lambda fp, text: F.when(F.col("fp") == F.col(fp), (canonical(F.col("text")) == canonical(F.col(text))).cast("double")).otherwise(F.lit(0.0))
    return changed.select("doc_id", "row_hash", "fp", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "edited_fp", alike("edited_fp", "edited").alias("near_edited"), alike("next_fp", "next_text").alias("near_next"))


def _edited_told_apart(docs: DataFrame, prints: DataFrame, odd: DataFrame, models: DataFrame) -> DataFrame:
    """For tables where different texts do have one hash: edited texts of such buckets, too, are compared with the bucket's first text."""
    own = prints.join(odd, (F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("id")) & (F.col("row_hash") == F.col("row")), "left").withColumn("fp", _apart("fp")).drop("id", "row", "other")
    canon = _pairs(docs).select(F.col("id").alias("__id"), F.col("row_hash").alias("__row"), canonical(F.col("edited")).alias("canon"), fingerprint(F.col("edited")).alias("bucket"))
    other = canon.join(models, F.col("bucket") == F.col("own")).where("canon <> model").select("__id", "__row", F.sha2("canon", 256).alias("other")).distinct()
    same = (F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("__id")) & (F.col("row_hash") == F.col("__row"))
    return own.join(other, same, "left").withColumn("edited_fp", _apart("edited_fp")).drop("__id", "__row", "other")
