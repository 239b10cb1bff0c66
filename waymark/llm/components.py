"""Connected components of a table of memberships, by least labels passed through groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, forget, materialize, split_join


def components(members: DataFrame) -> DataFrame:
    """``members`` (node long, hub long): nodes that share a hub are linked.  Returns node, component (least node).

    Each round takes the least label over every hub and then over every node's hubs, and jumps to the label's
    own label, so long chains shrink fast.  A hub costs one aggregated row for each task, and its members get its
    label by broadcast if it holds more than a share of all rows, so a hub of any size keeps no task.  Rounds are
    written to the shared folder, so no lineage grows.  Null nodes or hubs are ignored.
    """
    members = materialize(members.where("node is not null and hub is not null").distinct())
    sizes = members.groupBy("hub").agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(sizes.where(F.col("n") > max(1000, members.count() / HOT_KEYS)).select("hub", F.lit(True).alias("hot")))
    labels = materialize(members.groupBy("node").agg(F.min("node").alias("label")))
    while True:
        hubs = members.join(labels, "node").groupBy("hub").agg(F.min("label").alias("low"))
        hubs = hubs.join(F.broadcast(hot), "hub", "left").select("hub", "low", F.coalesce("hot", F.lit(False)).alias("hot"))
        hubs = materialize(hubs)
        near = split_join(members, hubs, "hub").groupBy("node").agg(F.min("low").alias("low"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        fresh = materialize(step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")))
        changed = fresh.where("label <> was").limit(1).count()
        forget(labels)
        forget(hubs)
        if not changed:
            forget(members)
            forget(hot)
            return fresh.select("node", F.col("label").alias("component"))
        labels = fresh.drop("was")
        labels.waymark_path = fresh.waymark_path
