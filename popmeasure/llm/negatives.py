"""Hard negatives of anchor vectors, scored by Kronecker-packed products.

Vectors have whole components. Several candidates' components at one place are shifted above 0 and set side by side
as separate fields of one 64-bit integer. An anchor's component then multiplies the whole integer once, and the
sums over all places hold each candidate's product in its own field, exactly: a field is as wide as the largest sum
needs (its sign included). The shift's share, the same for all candidates of an anchor, is taken off again.

Anchors and candidates meet in cells: a block of anchors and a bucket of candidates, both of bounded size, joined by an
equality of the cell's numbers. Each cell gives its best few of each anchor; a grouped limit keeps the best of all cells.
Labels and vectors are no keys, so a label or a vector that a third of the rows has burdens no task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, ready, written

#: Anchors and candidates of a cell, in expectation, and anchors whose products are held at a time.
ANCHORS, CANDIDATES, STEP = 2048, 16384, 64
#: Components lie below this, so that 64 products always fit one field of one integer.
LARGEST = 1 << 27
#: Stands in for an id that is null, after all others.
NO_ID = (1 << 63) - 1


def whole(vector: str = "embedding", scale: int = 256):
    """floor(scale * x) of each component x as a double; a component beyond LARGEST is an error that names it."""
    value = lambda x: F.floor(x.cast("double") * scale)
    checked = lambda v: F.when(F.abs(v) < LARGEST, v.cast("int")).otherwise(F.raise_error(F.concat(F.lit("component out of range: "), v.cast("string"))).cast("int"))
    return F.transform(F.transform(vector, value), checked)


def known(vector: str = "embedding"):
    """Whether there is a vector and all its components are finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products of anchors (m x d) and rows (n x d), whole numbers: m x n."""
    m, n, d = len(anchors), len(rows), anchors.shape[1]
    if not (m and n and d):
        return np.zeros((m, n), np.int64)
    shift = max(0, -int(rows.min()))
    shifted = rows + shift
    width = (int(np.abs(anchors).sum(axis=1).max()) * int(shifted.max())).bit_length() + 1
    if width > 63:
        raise OverflowError("inner products need more than 63 bits")
    fields = 63 // width
    columns = -(-n // fields)
    packed = np.zeros((d, columns), np.int64)
    for k in range(fields):
        own = shifted[k * columns : (k + 1) * columns].T
        packed[:, : own.shape[1]] += own << (width * k)
    sums, once = np.zeros((m, columns), np.int64), np.empty((m, columns), np.int64)
    for c in range(d):
        np.multiply(anchors[:, c, None], packed[c], out=once)
        sums += once
    sums += sum(1 << (width * k + width - 1) for k in range(fields))  # now no field borrows from the next one
    out, mask = np.empty((m, fields * columns), np.int64), (1 << width) - 1
    for k in range(fields):
        out[:, k * columns : (k + 1) * columns] = (sums >> (width * k)) & mask
    return out[:, :n] - ((1 << (width - 1)) + shift * anchors.sum(axis=1))[:, None]


def _first(row: np.ndarray, column: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of entries (row, column, score) the places of each row's first `most`: higher scores first, ties by column."""
    order = np.lexsort((column, -score, row))
    begin = np.searchsorted(row[order], row[order], "left")
    return order[np.arange(len(order)) - begin < most]


def _best(scores: np.ndarray, valid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's first `most` valid scores."""
    n, least = scores.shape[1], np.iinfo(np.int64).min
    own = np.where(valid, scores, least)
    bar = np.partition(own, n - most, axis=1)[:, n - most] if n > most else np.full(len(own), least)
    row, column = np.nonzero(valid & (own >= bar[:, None]))
    keep = _first(row, column, own[row, column], most)
    return row[keep], column[keep]


class _Rows:
    """One side of a cell: rows of one length of vectors, in the order of their ids."""

    def __init__(self, table: pa.Table, length: int):
        table = table.combine_chunks()
        lists = table.column("vector").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        keep = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == length)
        ids = table.column("vec_id").fill_null(NO_ID).to_numpy()[keep]
        keep = keep[np.argsort(ids, kind="stable")]
        self.at = keep
        self.id = table.column("vec_id").fill_null(NO_ID).to_numpy()[keep]
        self.label = table.column("label").to_numpy()[keep]
        self.vector = lists.take(pa.array(keep)).flatten().to_numpy().astype(np.int64).reshape(len(keep), length)


def _lengths(table: pa.Table) -> list[int]:
    lists = table.column("vector").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return np.unique(np.diff(lists.offsets.to_numpy())).tolist()


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=values == NO_ID)


def _positives(anchors: pa.Table, rows: pa.Table, most: int) -> pa.Table:
    """no, id, score: in one cell each anchor's best other rows of its label. Only products within a label are formed."""
    nos, found = anchors.column("no").to_numpy(), []
    for length in _lengths(anchors):
        left, right = _Rows(anchors, length), _Rows(rows, length)
        for label in np.unique(left.label).tolist():
            a, b = np.flatnonzero(left.label == label), np.flatnonzero(right.label == label)
            for part in np.array_split(a, -(-len(a) // STEP)) if len(b) else []:
                scores = products(left.vector[part], right.vector[b])
                row, column = _best(scores, left.id[part][:, None] != right.id[b], most)
                found.append((nos[left.at[part]][row], right.id[b][column], scores[row, column]))
    none = np.zeros(0, np.int64)
    no, ids, score = (np.concatenate([none, *x]) for x in (zip(*found, strict=True) if found else ([], [], [])))
    return pa.table({"no": pa.array(no), "id": _ids(ids), "score": pa.array(score)})


def _negatives(anchors: pa.Table, rows: pa.Table, most: int, low: int, high: int) -> pa.Table:
    """no, place, id, score: in one cell, for each anchor and positive (place), the best rows of other labels with low to high percent of its score."""
    nos, found = anchors.column("no").to_numpy(), []
    wanted = anchors.column("wanted").to_pylist()
    for length in _lengths(anchors):
        left, right = _Rows(anchors, length), _Rows(rows, length)
        for begin in range(0, len(left.id), STEP) if len(right.id) else []:
            part = slice(begin, begin + STEP)
            scores = products(left.vector[part], right.vector)
            goals = [wanted[k] for k in left.at[part]]
            places = max(len(g) for g in goals)
            # least and greatest score for each place; an empty range where an anchor has fewer positives
            least = np.array([[-(-low * p // 100) for p in g] + [1] * (places - len(g)) for g in goals], np.int64)
            greatest = np.array([[high * p // 100 for p in g] + [0] * (places - len(g)) for g in goals], np.int64)
            fits = (scores >= least.min(axis=1)[:, None]) & (scores <= greatest.max(axis=1)[:, None])
            row, column = np.nonzero(fits & (left.label[part][:, None] != right.label))
            score = scores[row, column]
            for place in range(places):
                own = np.flatnonzero((score >= least[row, place]) & (score <= greatest[row, place]))
                own = own[_first(row[own], column[own], score[own], most)]
                found.append((nos[left.at[part]][row[own]], np.full(len(own), place), right.id[column[own]], score[own]))
    none = np.zeros(0, np.int64)
    no, place, ids, score = (np.concatenate([none, *x]) for x in (zip(*found, strict=True) if found else ([], [], [], [])))
    return pa.table({"no": pa.array(no), "place": pa.array(place.astype(np.int32)), "id": _ids(ids), "score": pa.array(score)})


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id, label, vector (whole numbers below LARGEST).

    Anchors are rows whose vec_id is divisible by `every`. Their positives are the best other rows of the same label, the
    negatives of each the best rows of other labels whose score is from low to high percent of the positive's. Higher scores
    come first, then smaller ids; a null id is no anchor and comes last. Only vectors of one length have a product.
    Rows that repeat an id are rows of their own, but none is its anchor's positive if it has the anchor's id; anchors that
    repeat id, label and vector count once. Fewer rows than asked for give fewer, an anchor without positives or
    negatives none, an empty table an empty result. Other columns are not read.
    """
    spark = ready(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector")
    anchors = written(rows.where(F.col("vec_id") % every == 0).distinct().withColumn("no", F.monotonically_increasing_id()), "anchors")
    blocks, buckets = -(-anchors.count() // ANCHORS) or 1, -(-rows.count() // CANDIDATES) or 1
    each = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(buckets)).cast("int").alias("bucket")
    candidates = rows.select("*", dealt).select("*", each(blocks, "block")).groupBy("block", "bucket")

    def cells(own: DataFrame):
        block = F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int").alias("block")
        return own.select("*", block).select("*", each(buckets, "bucket")).groupBy("block", "bucket").cogroup(candidates)

    best = cells(anchors).applyInArrow(lambda a, b: _positives(a, b, positives), "no long, id long, score long")
    order = W.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = written(best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).withColumn("place", F.col("place") - 1), "positives")
    goals = best.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("g")).select("no", F.transform("g", lambda g: g["score"]).alias("wanted"))
    found = cells(anchors.join(goals, "no")).applyInArrow(lambda a, b: _negatives(a, b, negatives, low, high), "no long, place int, id long, score long")
    order = W.partitionBy("no", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = best.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}).join(anchors.select("no", F.col("vec_id").alias("anchor_id")), "no")
    out = named.join(found.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}), ["no", "place"])
    out = written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    dropped(anchors, best)
    return out


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the embeddings. Rows with a null label or vector, or a component that is null or not finite, take no part; every seventh id has the next label."""
    rows = ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("label").isNotNull() & known())
    label = F.col("label").cast("long")
    return hard_negatives(rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole().alias("vector")))


def op13_sql() -> str:
    return """WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM kept a JOIN kept b ON len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
    positives AS (SELECT anchor_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM scored WHERE same AND id <> anchor_id) WHERE k <= 5)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score) WHERE rank <= 5"""
