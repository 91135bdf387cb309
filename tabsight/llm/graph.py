"""Connected components of a link table, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabsight.llm.common import forget, materialize

LINKS = "a long, b long"


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b): the smallest node reachable.

    Each round hooks a node to the smallest of itself and its neighbours, follows the hooks
    twice, and contracts the links; at least half of the nodes that still have links vanish,
    so rounds grow with the logarithm of the largest component.  Rounds are written tables in
    the shared folder.  Minima are partially aggregated and joins are on node ids, so a node
    with very many links is split like any skewed key.  Loops and repeats are allowed.
    """
    open_links = materialize(
        links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
        .dropna().distinct(), "links")
    nodes = open_links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = materialize(nodes.withColumn("component", F.col("node")), "labels")
    open_links_now = open_links.filter("a <> b")
    stale = []
    while True:
        both = open_links_now.select("a", "b").unionByName(open_links_now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up"))
        hook = materialize(hook, "hooks")
        if hook.isEmpty():
            forget(hook)
            break
        for _ in range(2):
            above = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
            further = materialize(hook.join(above, "up").select("a", F.col("top").alias("up")), "hooks")
            forget(hook)
            hook = further
        renamed = hook.select(F.col("a").alias("component"), F.col("up").alias("_up"))
        fresh_labels = materialize(
            labels.join(renamed, "component", "left").select("node", F.coalesce("_up", "component").alias("component")), "labels")
        left = open_links_now.join(hook.select("a", F.col("up").alias("ua")), "a").join(
            hook.select(F.col("a").alias("b"), F.col("up").alias("ub")), "b")
        fresh_links = materialize(
            left.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).filter("a <> b").distinct(), "links")
        stale = [labels, open_links, hook]
        labels, open_links, open_links_now = fresh_labels, fresh_links, fresh_links
        forget(*stale)
    # a contracted name is a member of its component, not always the smallest one
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(least, "component").select("node", F.col("least").alias("component"))
