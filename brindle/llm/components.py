"""Connected components of a graph, by repeated hooking onto the least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._tables import MANY, hot_keys, spread_join
from brindle.session import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of the component) for every node of ``edges`` (a, b); nodes are any type that has an order.

    Each round joins every node with its neighbours' roots, takes the least, and follows the root's root
    once; a node's label can only fall, and the loop ends when none does. A node with very many edges (a star's
    centre), or a root of very many nodes, is spread over tasks; what is compared on the driver is one number.

    Defined results: repeated edges count once; an edge with a null end, and one from a node to itself, joins nothing
    (a node that has no other isn't in the result); no edges give no rows; other columns are left behind."""
    e = edges.select("a", "b").where("a <> b")
    e = stored(e.union(e.select(F.col("b"), F.col("a"))).distinct().toDF("a", "b"))
    stars = hot_keys(e, ["b"])
    labels = stored(e.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    many = labels.count() > MANY
    while True:
        near = spread_join(e, labels.withColumnRenamed("node", "b"), ["b"], stars, "a").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        hooked = stored(hooked) if many else hooked
        up = labels.select(F.col("node").alias("next"), F.col("root").alias("up"))
        roots = hot_keys(hooked, ["next"]) if many else None
        new = spread_join(hooked, up, ["next"], roots, "node")  # every next is a node
        new = stored(new.select("node", F.least("next", "up").alias("root"), (F.least("next", "up") < F.col("root")).alias("moved")))
        labels = new.select("node", "root")
        if not new.where("moved").head(1):
            return labels
