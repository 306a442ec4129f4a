"""Connected components of links, as joins that converge in a few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``links``.

    Each round a node takes the smallest label among its neighbours, then the
    label of its label.  Every round's labels are written to the shared folder; a hot node's
    links are combined before they are shuffled, and its joins can be split.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b).alias("x"), F.col(a).alias("y")))
    both = materialise(both.filter("x <> y").distinct(), "links")
    # Not written: its rows lie by node already, as the first round's joins need them.
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("root"))
    while True:
        seen = both.join(labels.hint("merge"), both["y"] == labels["node"]).groupBy(F.col("x").alias("n2")).agg(F.min("root").alias("near"))
        nearer = labels.join(seen, F.col("node") == F.col("n2")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # The label of the label, as it was before this round: no further than it is now, and at hand.
        of_root = labels.select(F.col("node").alias("n3"), F.col("root").alias("far"))
        jumped = nearer.join(of_root.hint("merge"), F.col("root") == F.col("n3"), "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root"))
        labels = materialise(jumped, "labels")
        if labels.filter("root <> was").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
