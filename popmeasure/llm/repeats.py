"""Repeated passages by longest-previous-factor arrays, over texts of any number of executors.

A byte goes if a string of `width` bytes that covers it also starts in a document with a smaller id.
Written in terms of suffixes: position i goes (with the width - 1 after it) if its longest previous
factor, the longest prefix of suffix i that also starts earlier, has width bytes or more, where earlier
means in a document with a smaller id. In suffix order such an earlier match is found at the previous or
next position whose document is smaller; the orders here are cut off at depth `width`, which is all that
the question needs.

No suffix array can hold a corpus, so the positions are dealt out first. Each window of width bytes
belongs to the least hash among its ANCHOR-byte strings; equal windows share it wherever they stand.
Neighbouring windows with one such anchor make a run (about one in fourteen bytes starts one).

1. Runs are dealt by anchor, as hashes. A run that equals a run of an earlier document is gone as a whole.
   Equal runs within a task are folded before the shuffle, so a passage that a third of all documents share
   sends a few rows a task. Most runs match nothing and end here. A phrase that very many documents have among
   different neighbours is an anchor of very many distinct runs: those are dealt as single windows, by hashes
   of the window, which spread over all parts.
2. The first of each distinct run whose anchor several documents share sends its bytes; they are dealt by
   anchor, and each part gets a suffix order by prefix doubling and its longest-previous-factor test.
3. Marks return to their documents (dealt by id) and cut the text.

Null texts count as empty and null ids as smaller than all others. Rows with equal ids are one document:
they remove nothing from each other. Texts shorter than width lose nothing. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, documents, dropped, next_prime, partitions, ready, text_bytes, written

WIDTH = 50
ANCHOR = 24
#: Bytes of text that one round of array work holds; windows that one run has at most.
CHUNK, LONGEST = 1 << 19, 256
#: Runs, and bytes of runs, that one task of a step should get.
RUNS, BYTES = 400_000, 1_000_000
MASK = (1 << 40) - 1
BASE = 0x9E3779B97F4A7C15
_RANDOM, _SECOND = np.random.default_rng(20240607).integers(1, 2**63, (2, 256)).astype(np.uint64)
#: Runs that a task remembers; distinct runs of an anchor from which its windows are dealt one by one;
#: one document of so many is counted to know these anchors beforehand; most anchors of such a list.
SLOTS, MANY, EVERY, HOTTEST = 1 << 20, BYTES // 64, 64, 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 2**64))


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size bytes from each position, by doubling."""
    out, done, block, width, n = None, 0, codes, 1, size
    while n:
        if n & 1:
            if out is None:
                out = block
            else:
                m = len(block) - done
                out = out[:m] * _power(width) + block[done : done + m]
            done += width
        n >>= 1
        if n:
            m = len(block) - width
            block = block[:m] * _power(width) + block[width:]
            width *= 2
    return out


def sliding_least(h: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (size - width)], h[size - width :]) if size > width else h


def runs_of(data: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """Runs of texts that lie one after another in data, from starts[k] to starts[k + 1]: text, offset in it, windows, anchor, hash of its bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    codes = _RANDOM[data]
    least = sliding_least(_mixed(gram_hashes(codes, ANCHOR)), width - ANCHOR + 1)
    lengths = np.diff(starts)
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = text[: len(least)] == text[width - 1 : width - 1 + len(least)]
    new = np.r_[True, (least[1:] != least[:-1]) | ~inside[:-1]] & inside
    at = np.flatnonzero(new)
    ends = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True]) + 1
    if len(at) and (ends - at).max() > LONGEST:  # periodic text
        cuts = -(-(ends - at) // LONGEST)
        first = np.repeat(at, cuts) + LONGEST * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
        ends = np.minimum(first + LONGEST, np.repeat(ends, cuts))
        at = first
    sums = np.r_[np.uint64(0), np.cumsum(codes * _powers(len(codes)))]
    whole = (sums[ends + width - 1] - sums[at]) * _inverse_powers(len(codes))[at]
    which = text[at]
    return which, at - starts[which], ends - at, least[at], _mixed(whole + (ends - at).astype(np.uint64))


_tables: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    if len(_tables.get(base, ())) < n:
        table = np.full(max(n, CHUNK), np.uint64(base))
        table[0] = 1
        _tables[base] = np.multiply.accumulate(table)
    return _tables[base][:n]


def _powers(n: int) -> np.ndarray:
    return _power_table(BASE, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _power_table(pow(BASE, -1, 2**64), n)


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each value, one plane after another: high bytes that hardly vary compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unplaned(blobs: list[bytes], size: int) -> np.ndarray:
    parts = []
    for blob in blobs:
        wide = np.zeros((len(blob) // size, 8), np.uint8)
        wide[:, :size] = np.frombuffer(blob, np.uint8).reshape(size, -1).T
        parts.append(wide.reshape(-1).view("<u8"))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


#: Columns of the packed tables and the bytes of their values. Ids are kept as unsigned numbers.
#: tag is a checksum of the text: rows with one id and different texts are told apart by it.
PLACE = {"doc": 8, "tag": 4, "at": 4, "windows": 2, "anchor": 5}
RUN, MARK = PLACE | {"whole": 8}, PLACE | {"partial": 1}
BLOBS = [*PLACE, "extra", "text"]
PACKED = "key int, kind int, " + ", ".join(f"{c} binary" for c in BLOBS)


def _pack(key: int, kind: int, columns: dict[str, np.ndarray], sizes: dict[str, int], text: bytes = b"") -> dict:
    out = {"key": key, "kind": kind, "extra": b"", "text": text}
    for name, size in sizes.items():
        out[name if name in PLACE else "extra"] = _planes(columns[name], size)
    return out


def _unpack(rows: list[dict], sizes: dict[str, int]) -> dict[str, np.ndarray]:
    return {name: _unplaned([r[name if name in PLACE else "extra"] for r in rows], size) for name, size in sizes.items()}


SCHEMA = pa.schema([("key", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in BLOBS)])
RUNS_OF, MARKS_OF, PIECES_OF = 0, 1, 2


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, SCHEMA)


def _parted(columns: dict[str, np.ndarray], by: np.ndarray):
    """(part, columns of that part), in the order that rows have."""
    order = np.argsort(by, kind="stable")
    by = by[order]
    starts = np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) if len(by) else []
    for a, b in zip(starts, np.r_[starts[1:], len(by)] if len(by) else [], strict=True):
        yield int(by[a]), {k: v[order[a:b]] for k, v in columns.items()}


def _signed_mod(ids: np.ndarray, n: int) -> np.ndarray:
    """pmod of ids that are held as unsigned numbers."""
    return ids.view(np.int64) % n


def _chunks(batch: pa.RecordBatch, most: int):
    """(ids, tags, data, starts) of consecutive rows with about `most` bytes."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        ids.append(i)
        texts.append(raw)
        size += len(raw)
        if size >= most:
            yield _laid(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield _laid(ids, texts)


def _laid(ids: list[int], texts: list[bytes]):
    tags = np.array([zlib.crc32(t) for t in texts], np.uint64)
    return np.array(ids, np.int64).view(np.uint64), tags, np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


class Seen:
    """What a task sent last: the least document of a run, in a slot that the run's hashes name. A run that meets a smaller
    document there is gone and need not be sent, so a passage of very many documents sends a few rows a task. A slot that
    another run took only costs a row more."""

    def __init__(self, slots: int = SLOTS):
        self.anchor, self.whole, self.doc = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
        self.used = np.zeros(slots, bool)

    def least(self, anchor: np.ndarray, whole: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The smaller of doc and the document held, for distinct runs; both are held or sent from now on."""
        slot = ((anchor ^ whole) % np.uint64(len(self.used))).astype(np.int64)
        same = self.used[slot] & (self.anchor[slot] == anchor) & (self.whole[slot] == whole)
        least = np.where(same, np.minimum(doc, self.doc[slot]), doc)
        slot, one = np.unique(slot, return_index=True)
        self.anchor[slot], self.whole[slot], self.doc[slot], self.used[slot] = anchor[one], whole[one], least[one], True
        return least


def _gone(c: dict[str, np.ndarray], seen: Seen | None = None) -> np.ndarray:
    """Which runs an equal run of a smaller document precedes, among these and those seen."""
    doc = c["doc"].view(np.int64)
    order = np.lexsort((doc, c["whole"], c["anchor"]))
    a, w, d = c["anchor"][order], c["whole"][order], doc[order]
    head = np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])] if len(d) else np.zeros(0, bool)
    least = seen.least(a[head], w[head], d[head]) if seen else d[head]
    out = np.zeros(len(d), bool)
    out[order] = d > least[np.cumsum(head) - 1]
    return out


def _marks(c: dict[str, np.ndarray], homes: int, key=lambda home: home) -> list[dict]:
    """Packed rows of runs that are gone, for their homes."""
    c = c | {"partial": np.zeros(len(c["doc"]), np.uint64)}
    return [_pack(key(h), MARKS_OF, x, MARK) for h, x in _parted(c, _signed_mod(c["doc"], homes))]


def _passed_on(home: int) -> int:
    """Key of marks that go through a step unchanged; the key of the same function is the home again."""
    return -1 - home


def _dealt(c: dict[str, np.ndarray], parts: int, homes: int, seen: Seen | None = None) -> list[dict]:
    """Packed rows of runs for the parts of their anchors, and marks of those that are gone already."""
    gone = _gone(c, seen)
    kept = {k: v[~gone] for k, v in c.items()}
    rows = [_pack(p, RUNS_OF, x, RUN) for p, x in _parted(kept, (kept["anchor"] % np.uint64(parts)).astype(np.int64))]
    return rows + _marks({k: v[gone] for k, v in c.items()}, homes, _passed_on)


def _single(data: np.ndarray, begins: np.ndarray, c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Runs as single windows, with hashes of the window in place of anchor and whole. begins: where each run's bytes begin in data."""
    n = c["windows"].astype(np.int64)
    run = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = begins[run] + offset
    first, second = (_mixed(gram_hashes(table[data], WIDTH))[place] if len(place) else np.zeros(0, np.uint64) for table in (_RANDOM, _SECOND))
    return {"doc": c["doc"][run], "tag": c["tag"][run], "at": c["at"][run] + offset.astype(np.uint64), "windows": np.ones(len(run), np.uint64), "anchor": first & np.uint64(MASK), "whole": second}


def _within(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def _send_runs(parts: int, homes: int, hot):
    def run(batches):
        seen = Seen()
        for batch in batches:
            for ids, tags, data, starts in _chunks(batch, CHUNK):
                which, at, windows, anchor, whole = runs_of(data, starts)
                if not len(which):
                    continue
                c = {"doc": ids[which], "tag": tags[which], "at": at.astype(np.uint64), "windows": windows.astype(np.uint64), "anchor": anchor & np.uint64(MASK), "whole": whole}
                wide = _within(hot.value, c["anchor"])
                if wide.any():
                    cut = _single(data, (starts[which] + at)[wide], {k: v[wide] for k, v in c.items()})
                    c = {k: np.concatenate([v[~wide], cut[k]]) for k, v in c.items()}
                yield from _table(_dealt(c, parts, homes, seen)).to_batches()

    return run


def _anchors(batches):
    for batch in batches:
        for _, _, data, starts in _chunks(batch, CHUNK):
            anchor, whole = runs_of(data, starts)[3:]
            yield pa.RecordBatch.from_arrays([pa.array((anchor & np.uint64(MASK)).view(np.int64)), pa.array(whole.view(np.int64))], names=["anchor", "whole"])


def hot_anchors(rows: DataFrame, many: int, every: int) -> np.ndarray:
    """Anchors of about `many` distinct runs or more, sorted; counted on the documents that a hash of the id picks, one of `every`.

    They only say how runs are dealt: what is removed is the same for any list. At most HOTTEST are returned: each has one of
    HOTTEST parts of all counted runs or more. Anchors below that are split where they meet (_match_runs).
    """
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    counts = picked.mapInArrow(_anchors, "anchor long, whole long").distinct().groupBy("anchor").agg(F.count("*").alias("n"))
    counts = written(counts.where(F.col("n") >= max(2, many // every)), "anchors")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") * HOTTEST >= total).select("anchor").toArrow().column(0).to_numpy()
    dropped(counts)
    return np.sort(found.astype(np.uint64))


def _match_runs(homes: int, many: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        marks = [r | {"key": _passed_on(r["key"])} for r in rows if r["kind"] == MARKS_OF]
        c = _unpack([r for r in rows if r["kind"] == RUNS_OF], RUN)
        order = np.lexsort((c["doc"].view(np.int64), c["whole"], c["anchor"]))
        c = {k: v[order] for k, v in c.items()}
        if len(order):
            head = np.r_[True, c["anchor"][1:] != c["anchor"][:-1]]
            sub = head | np.r_[True, c["whole"][1:] != c["whole"][:-1]]
            first = c["doc"][sub]
            later = c["doc"] != first[np.cumsum(sub) - 1]
            groups = np.cumsum(head[sub]) - 1  # group of each distinct run
            begins = np.flatnonzero(head[sub])
            mixed = np.minimum.reduceat(first, begins) != np.maximum.reduceat(first, begins)
            partial = ~later & mixed[groups][np.cumsum(sub) - 1]
            keep = later | partial
            crowded = np.diff(np.r_[begins, len(first)])[groups][np.cumsum(sub) - 1] > many
            found = {k: v[keep] for k, v in c.items()} | {"partial": (partial * (1 + crowded))[keep].astype(np.uint64)}
            marks += [_pack(h, MARKS_OF, x, MARK) for h, x in _parted(found, _signed_mod(found["doc"], homes))]
        return _table(marks)

    return run


def _send_pieces(parts: int, homes: int):
    """Texts of a home and its marks: the bytes of runs that must be compared, or their windows one by one where an anchor has very many runs."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        c = _unpack(marks.to_pylist(), MARK)
        text_of = {(i, tag): raw for i, tag, raw in _rows(docs)}

        def texts(c: dict[str, np.ndarray]) -> list[bytes]:
            places = zip(c["doc"].view(np.int64).tolist(), c["tag"].tolist(), c["at"].tolist(), c["windows"].tolist(), strict=True)
            return [text_of[doc, tag][at : at + windows + WIDTH - 1] for doc, tag, at, windows in places]

        few, wide = ({k: v[c["partial"] == n] for k, v in c.items()} for n in (1, 2))
        rows = [_pack(part, PIECES_OF, x, PLACE, b"".join(texts(x))) for part, x in _parted(few, (few["anchor"] % np.uint64(parts)).astype(np.int64))]
        sizes = wide["windows"].astype(np.int64) + WIDTH - 1
        data = np.frombuffer(b"".join(texts(wide)), np.uint8)
        return _table(rows + _dealt(_single(data, np.cumsum(sizes) - sizes, wide), parts, homes))

    return run


def _rows(docs: pa.Table):
    """id, checksum and bytes of each text."""
    for i, t in zip(docs.column("id").to_pylist(), docs.column("text"), strict=True):
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        yield i, zlib.crc32(raw), raw


def suffix_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first `depth` bytes, by prefix doubling; past the end counts as least."""

    def ranked(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ordered = keys[order]
        rank = np.empty(len(keys), np.uint64)
        rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
        return rank

    def beyond(rank: np.ndarray, step: int) -> np.ndarray:
        return np.r_[rank[step:], np.zeros(min(step, len(rank)), np.uint64)]

    wide = np.r_[data.astype(np.uint64), np.zeros(8, np.uint64)]
    keys = np.zeros(len(data), np.uint64)
    start = min(7, depth)
    for k in range(start):
        keys = (keys << np.uint64(9)) | (wide[k : k + len(data)] + np.uint64(1)) * (np.arange(len(data)) + k < len(data))
    rank, known = ranked(keys), start
    while known < depth:
        step = min(known, depth - known)
        rank = ranked(rank << np.uint64(32) | beyond(rank, step))
        known += step
    return rank


def earlier_matches(rank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which positions have a longest previous factor that reaches the depth of the ranks.

    In the order (rank, document) the previous smaller position of a suffix that has an earlier match is in
    its own class of equal ranks; the next smaller one is always in another class, whose suffixes share
    fewer bytes. So a position's factor reaches the depth if the class begins with a smaller document.
    """
    order = np.lexsort((doc, rank))
    ordered, docs = rank[order], doc[order]
    head = np.r_[True, ordered[1:] != ordered[:-1]] if len(order) else np.zeros(0, bool)
    previous = docs[head][np.cumsum(head) - 1] if len(order) else docs
    out = np.zeros(len(rank), bool)
    out[order] = previous < docs
    return out


def _compare(homes: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        marks = [r | {"key": _passed_on(r["key"])} for r in rows if r["kind"] == MARKS_OF]
        single = _unpack([r for r in rows if r["kind"] == RUNS_OF], RUN)
        gone = _gone(single)
        marks += _marks({k: v[gone] for k, v in single.items()}, homes)
        rows = [r for r in rows if r["kind"] == PIECES_OF]
        if not rows:
            return _table(marks)
        c = _unpack(rows, PLACE)
        data = np.frombuffer(b"".join(r["text"] for r in rows), np.uint8)
        windows = c["windows"].astype(np.int64)
        sizes = windows + WIDTH - 1
        begins = np.cumsum(sizes) - sizes
        rank = suffix_ranks(data, WIDTH)
        piece = np.repeat(np.arange(len(windows)), windows)
        offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = earlier_matches(rank[begins[piece] + offset], c["doc"].view(np.int64)[piece])
        new = hit & np.r_[True, ~hit[:-1] | (piece[1:] != piece[:-1])] if len(hit) else hit
        last = hit & np.r_[~hit[1:] | (piece[1:] != piece[:-1]), True] if len(hit) else hit
        first, end = np.flatnonzero(new), np.flatnonzero(last)
        found = {"doc": c["doc"][piece[first]], "tag": c["tag"][piece[first]], "at": c["at"][piece[first]] + offset[first].astype(np.uint64), "windows": (end - first + 1).astype(np.uint64), "anchor": c["anchor"][piece[first]]}
        return _table(marks + _marks(found, homes))

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Spans that touch or overlap, made one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(docs: pa.Table, marks: pa.Table) -> pa.Table:
    c = _unpack(marks.to_pylist(), MARK)
    c = {k: v[c["partial"] == 0] for k, v in c.items()}
    at = c["at"].astype(np.int64)
    end = at + c["windows"].astype(np.int64) + WIDTH - 1
    own: dict[tuple[int, int], list[int]] = {}
    for k, place in enumerate(zip(c["doc"].view(np.int64).tolist(), c["tag"].tolist(), strict=True)):
        own.setdefault(place, []).append(k)
    out = []
    for i, tag, raw in _rows(docs):
        mine = own.get((i, tag), [])
        spans = merged(at[mine], end[mine]) if mine else []
        kept, last = [], 0
        for x, y in spans:
            kept.append(raw[last:x])
            last = y
        kept = b"".join([*kept, raw[last:]]) if spans else raw
        out.append({"doc_id": None if i == NULL_ID else i, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"start": x, "end": y} for x, y in spans]})
    return pa.Table.from_pylist(out, _RESULT)


def repeated_passages(docs: DataFrame, many: int = MANY, every: int = EVERY) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte offsets that go).

    many and every (see MANY and EVERY) change how the work is dealt, never the result.
    """
    spark = ready(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), "text")
    size, least = text_bytes(rows), partitions(spark)
    homes = next_prime(max(2 * least, size // 16_000_000))
    parts = max(least, size // 14 // RUNS)
    hot = spark.sparkContext.broadcast(hot_anchors(rows, many, every))
    runs = rows.mapInArrow(_send_runs(parts, homes, hot), PACKED)
    marks = written(runs.groupBy("key").applyInArrow(_match_runs(homes, many), PACKED), "marks")
    home = rows.withColumn("home", F.pmod("id", F.lit(homes)).cast("int"))
    weight = marks.agg(F.sum(F.octet_length("windows"))).first()[0] or 0
    pieces = home.groupBy("home").cogroup(marks.groupBy("key")).applyInArrow(_send_pieces(max(least, weight // 2 * 64 // BYTES), homes), PACKED)
    spans = pieces.groupBy("key").applyInArrow(_compare(homes), PACKED)
    return home.groupBy("home").cogroup(marks.union(spans).groupBy("key")).applyInArrow(_cut, RESULT)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, what was removed and a digest of what is left, of every document; a null text counts as empty."""
    return repeated_passages(documents(spark, sf_dir)).drop("spans")
