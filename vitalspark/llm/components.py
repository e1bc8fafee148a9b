"""Connected components of a link table, by rounds of joins (large and small
stars), with a written table between rounds so that lineage stays short."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import remove, shared_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back."""
    return kept(df, name)[0]


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table of :func:`stored` and its path, for :func:`done`."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.parquet(path), path


def done(spark, *paths: str) -> None:
    """Delete stored tables whose readers have written, and let the driver's
    collector find the shuffles that nothing refers to: their files are removed
    from the executors only then."""
    remove(spark, *paths)
    gc.collect()
    spark._jvm.System.gc()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour of a node is tied to the node's
    smallest neighbour. Small star: a node and its smaller neighbours are."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not its own
    root; root is the smallest node reachable. Raises if ``max_rounds`` do not
    suffice (each round shrinks paths by a factor)."""
    spark = links.sparkSession
    first = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, path = kept(first, "links")
    state = None
    for _ in range(max_rounds):
        before = path
        edges, path = kept(_star(_star(edges, True), False), "stars")
        done(spark, before)
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(found) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(found)
    raise RuntimeError("components did not settle")
