"""Connected groups of near-duplicates, by hooking of roots with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.sources.tables import discard, materialize


def connected(nodes: DataFrame, pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """(tid, group): the smallest id that a chain of pairs (tid_a, tid_b) leads to; a node without pairs is its own group.

    Every node has a label, at first itself. Every round the least label of labels around a node goes to the node and to its
    label's node, so whole trees are hooked, and a node takes the label of its label. Labels only fall and stay in their group;
    it ends when none changes, and then both ends of every pair have one label. Beyond ``rounds`` it raises: no group comes out split.
    Only nodes with pairs take part; the minima are partial aggregates, so a node or label with very many members is no hot group.
    Each round is two written tables.
    """
    edges = materialize(pairs.select("tid_a", "tid_b").unionAll(pairs.select(F.col("tid_b"), F.col("tid_a"))).distinct().toDF("tid", "to"), "edges")
    labels = materialize(edges.groupBy("tid").agg(F.least(F.col("tid"), F.min("to")).alias("group")), "labels")
    for _ in range(rounds):
        of = labels.select(F.col("tid").alias("group"), F.col("group").alias("next"))
        jumped = materialize(labels.join(of, "group").select("tid", "group", "next"), "jumped")
        around = edges.join(jumped.select(F.col("tid").alias("to"), "next"), "to").groupBy("tid").agg(F.min("next").alias("near"))
        seen = jumped.join(around, "tid").select("tid", "group", F.least("next", "near").alias("near"))
        hooks = seen.groupBy("group").agg(F.min("near").alias("hook")).withColumnRenamed("group", "tid")
        new = materialize(seen.join(hooks, "tid", "left").select("tid", F.col("group").alias("old"), F.least("near", F.coalesce("hook", "near")).alias("group")), "labels")
        discard(jumped)
        discard(labels)
        labels = new.select("tid", "group")
        if not new.where(F.col("old") != F.col("group")).limit(1).count():
            break
    else:
        raise RuntimeError(f"groups still change after {rounds} rounds")
    return nodes.select("tid").distinct().join(labels, "tid", "left").select("tid", F.coalesce("group", "tid").alias("group"))
