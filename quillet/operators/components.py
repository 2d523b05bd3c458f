"""Connected components of any graph of pairs, and cut points that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of ``spark.checkpoint.dir``; only a local master may take a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quillet-checkpoint-"))
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """node, root of edges (a, b) of any one orderable type: every node but the roots, with the least node of its component.

    Star contraction: every node's larger neighbours are linked to its least neighbour, then its smaller ones are, until
    nothing changes. Links get fewer or shorter with each round, so rounds grow with the logarithm of the longest path. The
    least neighbour is a sum on the map side; a hot centre is a key that a join can split.
    """
    pairs = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut_lineage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = cut_lineage(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        seen = pairs.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if seen.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty():  # all are stars
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
