"""Connected components of a link table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(links: DataFrame) -> DataFrame:
    """id and component (the least reachable id) of every id in ``links`` (a, b).

    Each round takes the least label among a node and its neighbours, then the
    label of that label, so paths halve; it ends when nothing changes. Rounds are
    checkpointed. Nothing is collected but the count of changes.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("component")))
    while True:
        around = edges.join(label, edges["b"] == label["id"]).groupBy("a").agg(F.min("component").alias("near"))
        near = label.join(around, label["id"] == around["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("near"))
        jump = label.select(F.col("id").alias("near"), F.col("component").alias("far"))
        new = cut(near.join(jump, "near").select("id", "old", F.least("near", "far").alias("component")))
        changed = new.where("old <> component").count()
        label = new.select("id", "component")
        if not changed:
            return label
