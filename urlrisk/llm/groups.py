"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.session import materialize


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: the smallest node it is connected with.

    Each round gives every node the smallest label among its neighbours' labels
    and then the label of that label, so labels travel along paths twice as far
    with each round. Only minima are kept per node, combined before the shuffle;
    no neighbour list is ever gathered. Rounds end when no label changes. Every
    round is written to the shared folder, so the lineage stays short.
    """
    links = links.filter("a != b")
    both = materialize(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        f"{name}-links",
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("root")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        # A node's old root learns of the smaller label too (hooking), which merges whole trees at once.
        better = labels.join(near, "node").select("node", "root", F.least("root", "_near").alias("_new"))
        hooked = better.groupBy(F.col("root").alias("node")).agg(F.min("_new").alias("_hook"))
        stepped = better.join(hooked, "node", "left").select("node", F.col("root").alias("_old"), F.least("_new", "_hook").alias("_to"))
        jump = stepped.select(F.col("node").alias("_to"), F.col("_to").alias("_jump"))
        following = materialize(
            stepped.join(jump, "_to", "left").select("node", "_old", F.least("_to", "_jump").alias("root")), name
        )
        labels = following.select("node", "root")
        if following.filter("root != _old").isEmpty():
            return labels
