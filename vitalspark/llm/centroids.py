"""Centroid clustering by dimension-sharded Lloyd rounds.

Vectors become integers and are cut into chunks of rows and blocks of columns;
a shard is all blocks of the same columns, and each of a round's first tasks has
rows of one shard and knows only that shard's slice of the centroids:

1. Partial distances: each block gives the exact integer sum of squares of its
   own columns, for every row and centroid.
2. Added up by chunk (the key of the reduce), the nearest centroid taken per
   row; only the row numbers of the nearest centroids go back.
3. Each shard meets these labels where its blocks lie (the blocks are stored
   bucketed by chunk, so the labels are shuffled and the blocks are not), sums
   its columns by cluster and replaces its own slice by the floored means.

The driver holds k * dim centroid numbers and nothing that grows with the rows.

Defined cases: vectors of another length, null ones and ones with a null, NaN or
infinite component are left out; null ids are kept (as the empty text where ids
are hashed), and so are repeated ids and rows, each a vector of its own; among
vectors of equal hash the smaller one by components starts first; extra columns
are ignored; an empty table gives an empty result and fewer than k vectors give
that many centroids. A component that is not within +-2**26 after scaling, or
more than 256 dimensions, raises: squared distances would no longer be exact in
64 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.llm.common import chunks, remove, shared_path, table

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Columns of a shard, and numbers of a chunk's distance table (rows * k).
BLOCK_COLUMNS, CHUNK_NUMBERS = 16, 1 << 18
#: Largest size of a scaled component, and most dimensions, for exact sums.
LARGEST, MOST_DIMENSIONS = 1 << 26, 256


def kept(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where((F.size(vector) == dim) & finite)


def first_centroids(df: DataFrame, key: str, vector: str, k: int, seed: str, scale: int) -> np.ndarray:
    """The k vectors of smallest hash: at most k rows a task and to the driver."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    top = df.select(F.sha2(text, 256).alias("h"), whole.alias("v")).orderBy("h", "v").limit(k)
    return np.asarray([r["v"] for r in top.collect()], np.int64)


def cut(df: DataFrame, dim: int, scale: int, edges: list[int], rows: int, kind: str) -> DataFrame:
    """(chunk, block, n, data, ids): the chunks' column blocks as int32 matrices;
    block 0 carries the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in chunks(batch, rows):
                values = piece.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                whole = np.floor(values.reshape(-1, dim) * scale)
                if len(whole) and np.abs(whole).max() > LARGEST:
                    raise ValueError(f"a scaled component is beyond {LARGEST}: distances would not be exact")
                whole = whole.astype(np.int32)
                data = [np.ascontiguousarray(whole[:, a:b]).tobytes() for a, b in zip(edges, edges[1:])]
                ids = pa.array([piece.column(0).to_pylist()] + [None] * (len(data) - 1), pa.list_(piece.column(0).type))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(data), pa.int64()), pa.array(range(len(data)), pa.int32()),
                     pa.array([len(whole)] * len(data), pa.int32()), pa.array(data, pa.binary()), ids],
                    names=["chunk", "block", "n", "data", "ids"],
                )
                chunk += 1

    return df.mapInArrow(run, f"chunk long, block int, n int, data binary, ids array<{kind}>")


def nearest(blocks: DataFrame, centroids: np.ndarray, edges: list[int]) -> DataFrame:
    """(chunk, labels, distances) of all chunks, as int32 and int64 vectors."""
    k = len(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, block, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                own = centroids[:, edges[block] : edges[block + 1]]
                x = np.frombuffer(data, np.int32).reshape(n, -1).astype(np.int64)
                sums = np.stack([((x - c) ** 2).sum(1) for c in own], 1)
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "sums": pa.array([sums.tobytes()], pa.binary())})

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s, np.int64) for s in group.column("sums").to_pylist()).reshape(-1, k)
        label = total.argmin(1)  # the first of equal ones
        least = total[np.arange(len(total)), label]
        return pa.table(
            {"chunk": group.column("chunk").slice(0, 1), "labels": pa.array([label.astype(np.int32).tobytes()], pa.binary()),
             "distances": pa.array([least.tobytes()], pa.binary())}
        )

    sums = blocks.select("chunk", "block", "n", "data").mapInArrow(partial, "chunk long, sums binary")
    return sums.groupBy("chunk").applyInArrow(add, "chunk long, labels binary, distances binary")


def moved(blocks: DataFrame, labels: DataFrame, centroids: np.ndarray, edges: list[int]) -> np.ndarray:
    """The centroids after each shard has replaced its slice by the floored means
    of its columns; empty clusters stay."""
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # of each shard: k rows of sums, and the rows' numbers
        for batch in batches:
            for block, n, data, label in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(data, np.int32).reshape(n, -1).astype(np.int64)
                own = total.setdefault(block, np.zeros((k, x.shape[1] + 1), np.int64))
                at = np.frombuffer(label, np.int32)
                np.add.at(own, at, np.c_[x, np.ones(n, np.int64)])
        for block, own in total.items():
            for j in np.flatnonzero(own[:, -1]).tolist():
                w = own.shape[1] - 1
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([block] * w, pa.int32()), "cluster": pa.array([j] * w, pa.int32()),
                     "at": pa.array(range(w), pa.int32()), "total": own[j, :-1], "n": np.full(w, own[j, -1])}
                )

    met = blocks.select("chunk", "block", "n", "data").join(labels.select("chunk", "labels"), "chunk")
    each = met.select("block", "n", "data", "labels").mapInArrow(sums, "block int, cluster int, at int, total long, n long")
    total = each.groupBy("block", "cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.expr("(total - pmod(total, n)) div n")  # rounded down, exact
    out = centroids.copy()
    for r in total.select("block", "cluster", "at", mean.alias("mean")).collect():  # k * dim numbers
        out[r["cluster"], edges[r["block"]] + r["at"]] = r["mean"]
    return out


def spread(ids: DataFrame, found: DataFrame, key: str, kind: str) -> DataFrame:
    """One row per vector: (key, cluster, distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                labels, distances = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in ((1, np.int32), (2, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(labels), pa.array(distances)], names=["id", "cluster", "distance"])

    out = ids.join(found, "chunk").select("ids", "labels", "distances")
    return out.mapInArrow(run, f"id {kind}, cluster int, distance long").withColumnRenamed("id", key)


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, k: int = CLUSTERS,
            rounds: int = ROUNDS, seed: str = SEED, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance) of all kept vectors, final centroids)."""
    if dim > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    spark: SparkSession = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    own = kept(df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("v")), "v", dim)
    edges = [*range(0, dim, BLOCK_COLUMNS), dim]
    rows = max(64, CHUNK_NUMBERS // k)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"blocks_{uuid.uuid4().hex}", shared_path(spark, "blocks")
    # chunk numbers are made once: everything reads them from the stored table
    whole = cut(own, dim, scale, edges, rows, kind).repartition(buckets, "chunk")
    whole.write.partitionBy("block").bucketBy(buckets, "chunk").option("path", path).saveAsTable(name)
    try:
        centroids = first_centroids(own, "id", "v", k, seed, scale)
        if not len(centroids):
            return spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long"), centroids.reshape(0, dim)
        blocks, spent = spark.table(name), []
        for _ in range(rounds + 1):
            spent.append(shared_path(spark, "labels"))
            nearest(blocks, centroids, edges).write.parquet(spent[-1])
            found = spark.read.parquet(spent[-1])
            if len(spent) <= rounds:
                centroids = moved(blocks, found, centroids, edges)
        out = shared_path(spark, "clusters")
        spread(blocks.where("block = 0").select("chunk", "ids"), found, key, kind).write.parquet(out)
        remove(spark, *spent)
        return spark.read.parquet(out), centroids
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def cluster_query(spark, sf_dir: str) -> DataFrame:
    """Per vector its cluster and distance, with the cluster's and the whole
    inertia and the digest of its centroid (tables of k rows)."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    rows = [(j, sums.get(j, 0), sum(sums.values()), digest(c)) for j, c in enumerate(centroids)]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
