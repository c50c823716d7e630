"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): label is the least node that is reachable.

    Each turn takes the least label among the neighbours and then the label of that label, so the
    number of turns is logarithmic in the length of paths. Labels are combined before they are
    shuffled; a node with very many links is a key of a join that adaptive execution can split.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("via"), F.col("label").alias("was"))
        of = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        turned = written(near.join(of, "via", "left").select("node", F.least("via", F.coalesce("far", "via")).alias("label"), "was"), "labels")
        labels = turned.select("node", "label")
        if turned.where("label <> was").isEmpty():
            return labels
