"""Byte-level BPE over a given vocabulary: encoding with a contiguous rank array, and decoding.

A text is cut into words by the vocabulary's own pattern. A word is held as a short array of parts with, next
to it, the array of ranks of adjacent parts: the least rank is found by a scan, the boundary there is
deleted, and the ranks of the two neighbours are looked up anew, until no adjacent parts merge. Words that
a worker has not met before are handled together, many words of one length as the rows of such arrays.
Words of very many parts take the same merges from a heap instead of a scan.

The vocabulary file has a fixed size and is the only thing that is broadcast. There is no shuffle.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

#: Words that a worker remembers, and characters of text that it handles at a time.
KNOWN_WORDS, CHUNK = 300_000, 1_000_000
#: Longest word, in bytes, that is scanned.
SHORT = 128
NEVER = np.iinfo(np.int32).max
#: Fixed value: the pattern of byte-level pre-tokenisation. White space is Unicode's property of that name.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte: itself where printable in Latin-1, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tables made from a tokenizer file: pairs of ids with their ranks, and the bytes of each id."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        size = max([*vocab.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for token, k in vocab.items():
            raw[k] = bytes(letters[c] for c in token)
        for token, k in self.special.items():
            raw[k] = token.encode()
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.bits = max(4, int(len(merges) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER, np.int32)
        left, at = np.arange(len(pairs)), self._slot(pairs)
        while len(left):  # open addressing: the first at a free slot takes it, the others step on
            free = self.keys[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            taken = left[free][first]
            self.keys[slots], self.ranks[slots] = pairs[taken], taken
            on = ~np.isin(left, taken)
            left, at = left[on], (at[on] + 1) & (len(self.keys) - 1)
        self.known: dict[str, bytes] = {}

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair of ids, NEVER if they don't merge."""
        pairs = left.astype(np.int64) << 32 | right
        at = self._slot(pairs)
        out = np.where(self.keys[at] == pairs, self.ranks[at], NEVER)
        open_ = np.flatnonzero((self.keys[at] != pairs) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[open_]]
            hit = seen == pairs[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def scan(self, words: list[bytes]) -> list[bytes]:
        """Ids (int32, packed) of words of one length, one row of parts and one of ranks for each word."""
        n, m = len(words[0]), len(words)
        parts = self.byte_id[np.frombuffer(b"".join(words), np.uint8).reshape(m, n)]
        out, rows, count = parts.copy(), np.arange(m), np.full(m, n)
        ranks = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(m, n - 1) if n > 1 else np.zeros((m, 0), np.int32)
        while n > 1:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            on = best != NEVER
            if not on.all():
                done = rows[~on]
                out[done, :n], count[done] = parts[~on], n
                parts, ranks, rows, at, best = parts[on], ranks[on], rows[on], at[on], best[on]
            if not len(rows):
                break
            n -= 1
            here = np.arange(len(rows))
            parts = np.take_along_axis(parts, np.arange(n) + (np.arange(n) > at[:, None]), axis=1)
            parts[here, at] = self.merged[best]
            ranks = np.take_along_axis(ranks, np.arange(n - 1) + (np.arange(n - 1) >= at[:, None]), axis=1)
            for side in (at - 1, at):
                k = np.flatnonzero((side >= 0) & (side < n - 1))
                ranks[k, side[k]] = self.rank(parts[k, side[k]], parts[k, side[k] + 1])
        if n == 1 and len(rows):
            out[rows, :1], count[rows] = parts, 1
        return [out[k, :c].tobytes() for k, c in enumerate(count.tolist())]

    def heap(self, word: bytes) -> bytes:
        """Ids of one long word: the same merges, least rank first and leftmost among equals."""
        parts = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        first = self.rank(np.array(parts[:-1], np.int64), np.array(parts[1:], np.int64)).tolist()
        waiting = [(r, k, parts[k], parts[k + 1]) for k, r in enumerate(first) if r != NEVER]
        heapq.heapify(waiting)
        while waiting:
            r, k, left, right = heapq.heappop(waiting)
            if parts[k] != left or after[k] < 0 or parts[after[k]] != right:
                continue
            gone = after[k]
            parts[k], parts[gone], after[k] = int(self.merged[r]), -1, after[gone]
            if after[k] >= 0:
                before[after[k]] = k
            for a in (before[k], k):
                if a >= 0 and after[a] >= 0:
                    x, y = parts[a], parts[after[a]]
                    rank = int(self.rank(np.array([x]), np.array([y]))[0])
                    if rank != NEVER:
                        heapq.heappush(waiting, (rank, a, x, y))
        return np.array([p for p in parts if p >= 0], np.int32).tobytes()

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > KNOWN_WORDS:
            self.known.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            by_size.setdefault(len(raw), []).append((w, raw))
        for size, group in by_size.items():
            found = self.scan([r for _, r in group]) if size <= SHORT else [self.heap(r) for _, r in group]
            self.known.update(zip((w for w, _ in group), found, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        pieces = [self.split.split(t) if self.split else [t] for t in texts]
        cut = [[self.words.findall(p) if k % 2 == 0 else p for k, p in enumerate(ps)] for ps in pieces]
        new = {w for ps in cut for p in ps[::2] for w in p if w not in self.known}
        if new:
            whole = {w for ps in cut for p in ps[::2] for w in p} if len(self.known) + len(new) > KNOWN_WORDS else new
            self.learn(whole)
        own = self.known.__getitem__
        return [b"".join([b"".join(map(own, p)) if k % 2 == 0 else np.int32(self.special[p]).tobytes() for k, p in enumerate(ps)]) for ps in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        size = self.size[ids]
        end = np.cumsum(size)
        at = np.arange(end[-1] if len(end) else 0) + np.repeat(self.start[ids] - (end - size), size)
        return self.data[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(content)


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with the added columns ids (array of int) and decoded (the text that ids decode to).

    Columns of these names are replaced; all others stay. A null text counts as empty and has no ids. The
    rows of docs are kept one by one, repeated ones too, and an empty table stays empty. Texts are whole,
    however long. The strings of special tokens are those tokens; no tokens are added.
    """
    spark = docs.sparkSession
    with open(path or vocabulary_path(), "rb") as file:
        content = spark.sparkContext.broadcast(file.read())
    kept = docs.select(*(c for c in docs.columns if c.lower() not in ("ids", "decoded")))
    text = [c.lower() for c in kept.columns].index("text")

    def run(batches):
        vocab = vocabulary(content.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and size < CHUNK:
                    size += len(texts[last])
                    last += 1
                packed = vocab.encode(texts[first:last])
                ids = [np.frombuffer(p, np.int32) for p in packed]
                offsets = np.r_[0, np.cumsum([len(i) for i in ids])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                decoded = pa.array([vocab.decode(i) for i in ids], pa.string())
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*rows.columns, lists, decoded], names=[*rows.schema.names, "ids", "decoded"])
                first = last

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of every document; a null text counts as empty."""
    rows = tokenised(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
