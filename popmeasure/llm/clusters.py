"""Centroid clustering (Lloyd) with the dimensions dealt out to shards.

Vectors are cut into column blocks: a chunk of rows, a shard of dimensions. A task that holds a block measures the rows'
exact partial squared distances from the shard's slices of all centroids. Blocks of one chunk are added by key, and each
row takes the nearest centroid. The assignment goes back to the blocks, and each shard sums its own columns by cluster
and updates its own slices. So no task ever holds a whole vector or a whole centroid while it measures or updates, and
the memory of a task depends on a block's size alone.

All components are whole numbers: sums, distances and floors are exact, in whatever order they are added. Centroids
(clusters times dimensions, both parameters) are the only thing that each task gets whole slices of; what is summed for
them is added up within each task first, so a round shuffles distances, labels, and a few numbers a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, ready, written
from .negatives import known, whole

#: Rows of a chunk at most, and dimensions of a shard.
ROWS, WIDTH = 4096, 16


def _numbers(column: pa.Array, shape: tuple[int, int]) -> np.ndarray:
    lists = column.flatten() if isinstance(column, pa.ListArray) else column
    return lists.to_numpy(zero_copy_only=False).reshape(shape)


def column_blocks(rows: DataFrame, dimensions: int) -> DataFrame:
    """chunk, shard, ids (of shard 0), rows, block (whole numbers of 4 bytes, row by row). rows: vec_id, vector of so many whole numbers. Written."""

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                n = part.num_rows
                values, ids = _numbers(part.column(1), (n, dimensions)).astype(np.int32), part.column(0).to_pylist()
                chunk, made = (task << 32) + made, made + 1
                shards = range(-(-dimensions // WIDTH))
                blocks = [np.ascontiguousarray(values[:, s * WIDTH : (s + 1) * WIDTH]).tobytes() for s in shards]
                own = [ids if s == 0 else None for s in shards]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(shards)), pa.array(list(shards), pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array([n] * len(shards), pa.int32()), pa.array(blocks, pa.binary())], names=["chunk", "shard", "ids", "rows", "block"])

    return written(rows.select(F.col("vec_id").cast("long"), "vector").mapInArrow(run, "chunk long, shard int, ids array<long>, rows int, block binary"), "column-blocks")


def slices_of(centroids: DataFrame) -> DataFrame:
    """cluster, at, x of single components to shard, slices: for each shard the centroids' components, in order of cluster and place."""
    parts = centroids.groupBy(F.floor(F.col("at") / WIDTH).cast("int").alias("shard"))
    return parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("cluster", "at", "x"))), lambda s: s["x"]).alias("slices"))


def partial_distances(rows: np.ndarray, slices: np.ndarray) -> np.ndarray:
    """Squared distances of rows (n x w) from slices (k x w), exact: as doubles while all sums stay below 2^53, else as longs."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(slices).max(initial=0)))
    kind = np.float64 if 4 * most * most * rows.shape[1] < 1 << 53 else np.int64
    x, c = rows.astype(kind), slices.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def assigned(blocks: DataFrame, centroids: DataFrame) -> DataFrame:
    """chunk, labels (4 bytes a row), distances (8 bytes a row) of the nearest centroid; ties go to the smaller number. Written."""

    def measure(batches):
        for batch in batches:
            wide, out = [], []
            for n, block, slices in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                rows = np.frombuffer(block.as_py(), np.int32).reshape(n, -1)
                far = partial_distances(rows.astype(np.int64), slices.values.to_numpy().reshape(-1, rows.shape[1]))
                wide.append(int(far.max(initial=0)) >= 1 << 31)
                out.append(far.astype(np.int64 if wide[-1] else np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(wide), pa.array(out, pa.binary())], names=["chunk", "rows", "wide", "partial"])

    def added(parts: pa.Table) -> pa.Table:
        n, total = parts.column("rows")[0].as_py(), 0
        for wide, p in zip(parts.column("wide").to_pylist(), parts.column("partial").to_pylist(), strict=True):
            total = total + np.frombuffer(p, np.int64 if wide else np.int32).reshape(n, -1).astype(np.int64)
        label = total.argmin(axis=1)
        return pa.table({"chunk": parts.column("chunk")[:1], "labels": pa.array([label.astype(np.int32).tobytes()], pa.binary()), "distances": pa.array([total[np.arange(n), label].tobytes()], pa.binary())})

    met = blocks.select("chunk", "shard", "rows", "block").join(F.broadcast(slices_of(centroids)), "shard")
    near = met.select("chunk", "rows", "block", "slices").mapInArrow(measure, "chunk long, rows int, wide boolean, partial binary")
    return written(near.groupBy("chunk").applyInArrow(added, "chunk long, labels binary, distances binary"), "assigned")


def updated(blocks: DataFrame, labels: DataFrame, centroids: DataFrame, clusters: int) -> DataFrame:
    """cluster, at, x: each component as the floor of its cluster's mean; clusters without rows stay. Each shard sums its own columns. Written."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, n, block, label in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rows, own = np.frombuffer(block, np.int32).reshape(n, -1), np.frombuffer(label, np.int32)
                # the last column counts the rows
                held = sums.setdefault(shard, np.zeros((clusters, rows.shape[1] + 1), np.int64))
                np.add.at(held, own, np.c_[rows, np.ones(n, np.int64)])
        for shard, held in sums.items():
            used, width = np.flatnonzero(held[:, -1]), held.shape[1] - 1
            at = np.tile(np.arange(width) + shard * WIDTH, len(used)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width).astype(np.int32)), pa.array(at), pa.array(held[used, :-1].ravel()), pa.array(np.repeat(held[used, -1], width))], names=["cluster", "at", "s", "n"])

    met = blocks.select("chunk", "shard", "rows", "block").join(labels.select("chunk", "labels"), "chunk").select("shard", "rows", "block", "labels")
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    sums = met.mapInArrow(run, "cluster int, at int, s long, n long").groupBy("cluster", "at").agg(wide("s").alias("s"), wide("n").alias("n"))
    means = sums.select("cluster", "at", F.expr("cast((s - pmod(s, n)) div n as bigint)").alias("mean"))
    return written(centroids.join(means, ["cluster", "at"], "left").select("cluster", "at", F.coalesce("mean", "x").alias("x")), "centroids")


def clustered(rows: DataFrame, dimensions: int, clusters: int, rounds: int, salt: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each row. rows: vec_id, vector of `dimensions` whole numbers.

    Centroids start as the rows with the smallest SHA-256 of salt and vec_id (ties: the smaller vector), as many as there are up
    to `clusters`; a null id has the hash of the salt alone. Equal centroids keep their numbers, and rows go to the smaller.
    Repeated rows are rows of their own. An empty table gives an empty result. Other columns are not read.
    """
    ready(rows.sparkSession)
    rows = rows.select(F.col("vec_id").cast("long"), "vector")
    start = rows.select(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "vector").orderBy("h", "vector").limit(clusters)
    # As many rows as there are clusters: one array, whose places are the centroids' numbers.
    ranked = start.agg(F.sort_array(F.collect_list(F.struct("h", "vector"))).alias("all")).select(F.posexplode("all").alias("cluster", "c"))
    centroids = written(ranked.select("cluster", F.posexplode("c.vector").alias("at", "x")).select("cluster", "at", F.col("x").cast("long").alias("x")), "centroids")
    blocks = column_blocks(rows, dimensions)
    for _ in range(rounds):
        labels = assigned(blocks, centroids)
        before, centroids = centroids, updated(blocks, labels, centroids, clusters)
        dropped(before, labels)
    labels = assigned(blocks, centroids)

    def named(batches):
        for batch in batches:
            for ids, label, far in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(label, np.int32)), pa.array(np.frombuffer(far, np.int64))], names=["vec_id", "cluster", "distance"])

    placed = blocks.where("shard = 0").select("chunk", "ids").join(labels, "chunk").select("ids", "labels", "distances").mapInArrow(named, "vec_id long, cluster int, distance long")
    placed = written(placed, "placed")
    spread = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    spread = spread.crossJoin(F.broadcast(spread.agg(F.sum("s").alias("all"))))
    names = centroids.groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"].cast("string")), ",").alias("c"))
    facts = spread.join(names, "cluster").select(F.col("cluster").alias("__c"), F.col("s").cast("long").alias("cluster_inertia"), F.col("all").cast("long").alias("inertia"), F.sha2("c", 256).alias("centroid_sha256"))
    # One row a cluster.
    facts = written(facts, "clusters")
    dropped(blocks, labels, centroids)
    return placed.join(F.broadcast(facts), F.col("cluster") == F.col("__c")).drop("__c")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings of 64 components, none null or not finite, in 40 clusters after 5 rounds."""
    rows = ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet").where((F.size("embedding") == 64) & known())
    return clustered(rows.select("vec_id", whole().alias("vector")), 64, 40, 5, "2:")


def op12_sql() -> str:
    def mean(k: int) -> str:
        return f"""near{k} AS MATERIALIZED (SELECT vec_id, v, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM (SELECT r.vec_id, r.v, m.c, CAST(list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(r.v, m.m)]) AS BIGINT) AS d FROM kept r, means{k} m) GROUP BY vec_id, v)"""

    def move(k: int) -> str:
        return f"""means{k} AS MATERIALIZED (SELECT c, coalesce(n, m) AS m FROM means{k - 1} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS n FROM (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM near{k - 1}, generate_series(1, 64) g(i) GROUP BY c, i) GROUP BY c) USING (c))"""

    steps = ", ".join([mean(0), *(f"{move(k)}, {mean(k)}" for k in range(1, 6))])
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    means0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS c, v AS m FROM kept ORDER BY sha256('2:' || vec_id) LIMIT 40), {steps}
    SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM near5 JOIN means5 USING (c)"""
