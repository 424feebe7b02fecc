"""Connected components of graphs of low degree, such as the cells of a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.tables import written


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """nodes (u) and undirected edges (u, v) of nodes, once each → u, component: the least node that is connected to u.

    Each round a node takes the least label among its own and its neighbours', and then the label of that node, so that
    labels jump; the rounds grow with the logarithm of the longest path. Each round is a table in the shared folder, and
    one row comes to the driver.
    """
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    now = written(nodes.select("u", F.col("u").alias("component")))
    for _ in range(rounds):
        told = both.join(now.select(F.col("u").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("near"))
        least = now.join(told, "u", "left").select("u", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("to"))
        least = written(least)
        jump = least.select(F.col("u").alias("to"), F.col("to").alias("further"))
        after = written(least.join(jump, "to").select("u", F.least("to", "further").alias("component"), (F.least("to", "further") < F.col("was")).alias("moved")))
        now = after.select("u", "component")
        if after.where("moved").isEmpty():
            return now
    raise RuntimeError("components have not settled")
