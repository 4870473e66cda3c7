"""Connected components over a table of links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoints(spark: SparkSession) -> None:
    """The session's shared checkpoint folder; one is made here only in local mode without one, as in tests. A cluster has to name one."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: driver and executors need a shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folio-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name below the shared checkpoint folder; it stays there for that folder's owner to clear."""
    ensure_checkpoints(spark)
    home = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{home.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 100) -> DataFrame:
    """id, component (the smallest id reachable) of every node with a link.

    Each round a node takes the smallest label of its neighbourhood and then that label's own label,
    so labels travel twice as far every round.
    """
    ensure_checkpoints(edges.sparkSession)
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "id").checkpoint()
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("c").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("c").alias("up"))
        new = step.join(jump, "c", "left").select("id", "old", F.least("c", F.coalesce("up", "c")).alias("c")).checkpoint()
        moved = not new.where("old <> c").isEmpty()
        labels = new.select("id", "c")
        if not moved:
            return labels.withColumnRenamed("c", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
