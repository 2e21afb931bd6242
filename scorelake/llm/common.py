"""What the operators share: shared folders, table reading, worker set-up and connected components."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.sources.scratch import delete, folder, kept, scratch, written

__all__ = ["connected_components", "delete", "folder", "kept", "partitions", "prepare", "scratch", "table", "worker_cache", "written"]

REPO = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Make this package importable in Python workers."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), REPO) if x)


_worker_cache: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker between batches. Workers outlive stages: the owner before is dropped."""
    if owner not in _worker_cache:
        _worker_cache.clear()
        _worker_cache[owner] = {}
    return _worker_cache[owner]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", most_rounds: int = 60) -> DataFrame:
    """Component of each node of an undirected edge list: rows (node, component), component = smallest node.

    Alternating large-star and small-star rounds; each round is written to the shared folder, and only the
    number of edges and a checksum reach the driver. Stars are built from partial minima, so a node with very
    many neighbours is aggregated before the shuffle. Loops and repeated edges are allowed; nulls are dropped.
    """
    spark = edges.sparkSession
    with scratch(spark):
        e = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null")
        e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        nodes = written(e.select(F.col("a").alias("node")).union(e.select("b")).distinct(), "nodes")
        e, seen = e.where("a <> b"), None
        for _ in range(most_rounds):
            with scratch(spark):  # a round's tables go when the next one's are there
                both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
                low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
                e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
                e = written(e, "large")
                low = e.groupBy("a").agg(F.min("b").alias("m"))
                j = e.join(low, "a")
                e = j.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
                e = kept(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small")
            now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError("connected_components did not settle")
        return kept(nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component")), "components")
