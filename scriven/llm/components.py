"""Connected components of a link table by minimum labels and pointer jumping, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (id, label): label is the smallest id of the component; ids without a link have no row.

    Each round takes the smallest label among a node's neighbours, then its label's label, so a chain
    shortens at least by half; a node of many links meets the others' labels in a partial minimum.
    """
    # first each node keeps its smallest neighbour, which takes over its other smaller neighbours: many links of one
    # node to a few others, as a large group of copies has them, become a few links among those others
    down = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("b").agg(F.min("a").alias("low"))
    others = down.join(least, "b").where("a <> low").select("low", "a").distinct()
    kept = least.select("low", F.col("b").alias("a")).union(others).distinct()
    both = written(kept.select("low", "a").union(kept.select("a", "low")).toDF("a", "b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("label"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.id == near.a).select("id", F.least("label", "near").alias("low"), F.col("label").alias("was"))
        up = labels.select(F.col("id").alias("low"), F.col("label").alias("top"))
        new = written(step.join(up, "low", "left").select("id", F.least("low", F.coalesce("top", "low")).alias("label"), "was"), "labels")
        if not new.where("label <> was").limit(1).count():
            return new.select("id", "label")
        labels = new.select("id", "label")
