"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.session import ensure_checkpoint_dir


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge; component is the least node that it reaches.

    Rounds of least-label propagation with pointer jumping, so a chain of n nodes takes about log2 n rounds. Least labels
    are combined before each shuffle; no neighbourhood is gathered, so a node of very many edges is no special case.
    Each round is cut by checkpoint() in the shared folder. Edges with a null end are dropped, loops make single nodes,
    repeated edges change nothing; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    given = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = given.unionByName(given.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")).checkpoint()
    for _ in range(max_rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        near = labels.join(seen, labels.node == seen.a, "left").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        root = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = near.join(root, "component", "left").select("node", "before", F.least("component", "root").alias("component")).checkpoint()
        if moved.where("component <> before").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")
    raise RuntimeError(f"no end after {max_rounds} rounds")
