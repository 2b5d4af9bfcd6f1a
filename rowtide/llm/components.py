"""Connected components of a graph whose edges are a table."""

from pyspark.sql import DataFrame, functions as F

from rowtide.llm.stage import staged


def components(edges: DataFrame) -> DataFrame:
    """Table ``node, label``: every node of the edges ``u, v`` with the smallest node it can reach.

    Each round a node takes the smallest label among itself and its neighbours, then the label of that
    label, until no label changes; path lengths halve at least, so rounds grow with the logarithm of a
    chain's length. Every round is written to the shared folder, and only the number of changed labels
    comes to the driver."""
    both = staged(
        edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    first = both.groupBy("u").agg(F.min("v").alias("low"))
    labels = staged(first.select(F.col("u").alias("node"), F.least("u", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("low"))
        better = labels.join(near.withColumnRenamed("u", "node"), "node").select(
            "node", F.col("label").alias("was"), F.least("label", "low").alias("hop"))
        jump = labels.select(F.col("node").alias("hop"), F.col("label").alias("far"))
        moved = staged(
            better.join(jump, "hop", "left").select("node", "was", F.coalesce("far", "hop").alias("label")), "labels")
        labels = moved.select("node", "label")
        if moved.where(F.col("was") != F.col("label")).isEmpty():
            return labels
