"""Connected components of links, by parent labels that are hooked and halved until none changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links(a, b): root is the smallest node that links reach.

    Each round lowers, over every link, the label of the near end and of the node that this label names (its root is
    hooked, so whole trees move) to the label of the far end's label; labels are halved as well. Rounds grow with the
    logarithm of the longest chain. The loop ends only when no label changes; then both ends of each link agree.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        up = label.join(label.select(F.col("node").alias("root"), F.col("root").alias("up")), "root").select("node", "root", "up")
        up = written(up, "parents")
        near = edges.join(up.select(F.col("node").alias("b"), "up"), "b").groupBy("a").agg(F.min("up").alias("near"))
        near = up.join(near.withColumnRenamed("a", "node"), "node")
        offers = near.select("node", F.least("up", "near").alias("offer")).union(near.select(F.col("root").alias("node"), F.col("near").alias("offer")))
        offers = offers.groupBy("node").agg(F.min("offer").alias("offer"))
        new = label.join(offers, "node").select("node", "root", F.least("root", "offer").alias("new"))
        new = written(new, "labels")
        label = new.select("node", F.col("new").alias("root"))
        if not new.where("root <> new").limit(1).count():
            return label
