"""Connected components of a table of links, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barspan.plans.tables import written


def components(links: DataFrame) -> DataFrame:
    """id and label (the smallest id it reaches) of every id in ``links`` (a, b).

    Each round lowers a label to the least one among the neighbours and then to that label's own label, so
    chains shorten by half or more; a round's labels are a written table. A node with very many links only
    meets them as partial minima and in skew-split joins.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        of_label = labels.select(F.col("id").alias("label"), F.col("label").alias("root"))
        jumped = written(lower.join(of_label, "label", "left").select("id", F.least("label", F.coalesce("root", "label")).alias("label"), "old"), "labels")
        labels = jumped.select("id", "label")
        if jumped.where(F.col("label") != F.col("old")).isEmpty():
            return labels
