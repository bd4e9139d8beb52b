"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.spark_util import materialize, skew_join


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label for every end of an edge `a`, `b`; the label is the smallest node of its component.

    Each round takes the least label of all neighbours, aggregated before it is shuffled, then the label's own label,
    so long chains close in a logarithmic number of rounds. Only one row of progress reaches the driver.
    """
    # both directions must come from one evaluation: edges may depend on the order in which rows arrive
    edges = materialize(edges.filter("a <> b").select("a", "b"))
    both = materialize(edges.union(edges.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    for _ in range(max_rounds):
        heard = skew_join(both, labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        up = nearer.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        jumped = skew_join(nearer, up, "label").select("node", F.least("label", "upper").alias("label"), "old")
        jumped = materialize(jumped)
        labels = jumped.select("node", "label")
        if jumped.filter("old <> label").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
