"""Filling fixed-capacity containers with items of varying length.

Items are dealt by hash to packing groups of a bounded number of containers, so a group
has the size mix of the whole and any number of groups is packed at once. Within a
group come first the items of sources and clusters that must be spread over many of its containers, then the others, each largest first. Open containers are ordered by the space left; each carries a bitmap of the
sources and one of the duplicate clusters of which it may take no more, one bit for each source and cluster of the group. The
search starts at the tightest container that fits and goes on to the next until one without a conflict is found; if
there is none, a container is opened. A container takes one item of a source or cluster; only where a group has more items of
one than it needs containers, so that some must meet whatever is done, as many as these have to share (items over containers, rounded up).
Containers are opened for this within :data:`SLACK` of the least number possible, so the constraint never costs more than that space.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers (at full use) and items of one packing group, about. A group leaves one or two containers
#: part-filled, so the space lost to grouping is under 0.1 per cent.
GROUP_CONTAINERS, GROUP_ITEMS = 2000, 20000
#: Share of the containers from which on a source or cluster is placed ahead of the rest, in steps of a factor of two.
SPREAD = 1 / 16
#: A container is opened to keep a conflict out only as long as there are at most so many more than the sizes need; beyond it the
#: tightest one without a copy is taken, else the tightest, and ``conflict`` tells.
SLACK = 0.02


def _shares(names: np.ndarray, containers: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each item the number of its name in the group, and of each number how many of its items a container may take."""
    _, number, count = np.unique(names, return_inverse=True, return_counts=True)
    return number, -(-count // max(containers, 1))


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number of each item, and whether it shares it with an item of its source or cluster.

    Items must be at most ``capacity``; sources and clusters are 64-bit hashes.
    """
    n_items = len(sizes)
    where, clash = np.zeros(n_items, dtype=np.int64), np.zeros(n_items, dtype=bool)
    if not n_items:
        return where, clash
    needed = -(-int(sizes.sum()) // capacity)
    marks = []
    for names in (sources, clusters):
        number, most = _shares(names, needed)
        marks.append((number, most, number >> 6, np.uint64(1) << (number & 63).astype(np.uint64)))
    full = [np.zeros((1024, int(m[0].max()) // 64 + 1), dtype=np.uint64) for m in marks]  # by container
    held: list[dict[tuple[int, int], int]] = [{}, {}]
    room, name = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)  # open containers, the least room first
    least = int(sizes.min())
    n = made = 0
    most_open = needed * (1 + SLACK)
    # what needs a large part of the containers for itself goes first, else they are full when it comes
    spread = np.maximum(*(np.bincount(m[0])[m[0]] for m in marks)) / needed if needed else np.zeros(n_items)
    rare = np.log2(np.maximum(spread, SPREAD) / SPREAD).astype(np.int64)
    for item in np.lexsort((clusters, sources, -sizes, -rare)):
        size = int(sizes[item])
        at = first = int(np.searchsorted(room[:n], size))
        step = 16
        while at < n:  # successor search: from the tightest on, in growing steps
            some = name[at : at + step]
            taken = sum(full[k][some, marks[k][2][item]] & marks[k][3][item] for k in (0, 1))
            free = np.flatnonzero(taken == 0)
            if len(free):
                at += int(free[0])
                break
            at, step = at + step, step * 4
        if at >= n > first and made >= most_open:
            clear = np.flatnonzero(full[1][name[first:n], marks[1][2][item]] & marks[1][3][item] == 0)
            at = first + (int(clear[0]) if len(clear) else 0)
        if first <= at < n:
            number, left = int(name[at]), int(room[at]) - size
            for column in (room, name):
                column[at : n - 1] = column[at + 1 : n]
            n -= 1
        else:
            number, left = made, capacity - size
            made += 1
            if made > len(full[0]):
                full = [np.concatenate([f, np.zeros_like(f)]) for f in full]
        where[item] = number
        for k in (0, 1):
            of, most, word, bit = marks[k]
            key = (number, int(of[item]))
            held[k][key] = count = held[k].get(key, 0) + 1
            clash[item] |= count > 1
            if count >= most[of[item]]:
                full[k][number, word[item]] |= bit[item]
        if left >= least:
            if n == len(room):
                room, name = (np.concatenate([c, np.zeros_like(c)]) for c in (room, name))
            at = int(np.searchsorted(room[:n], left))
            for column, value in ((room, left), (name, number)):
                column[at + 1 : n + 1] = column[at:n].copy()
                column[at] = value
            n += 1
    return where, clash


def pack(items: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """Assign items (item_id, source, cluster, size) to containers of each capacity.

    Result: container, capacity, bin_id, item_id, part_no, size, conflict. An item within the
    capacity is whole and has part_no 1. One that exceeds it is cut: full parts have
    a container each, the rest is packed like an item. Items of size 0 or null size take
    no space and are placed too. A null source or cluster is a source or cluster of its own.
    A capacity that is null or under 1 takes nothing. ``items`` should be a written table: it is read twice.
    """
    usable = sorted((n, int(c)) for n, c in capacities.items() if c and c > 0)
    schema = "container string, capacity long, bin_id string, item_id long, part_no int, size long, conflict boolean"
    spark = items.sparkSession
    if not usable:
        return spark.createDataFrame([], schema)
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    total = items.agg(F.sum(size).alias("size"), F.count("*").alias("n")).first()
    kinds = F.array(
        *(
            F.struct(
                F.lit(n).alias("container"),
                F.lit(c).cast("long").alias("capacity"),
                F.lit(max(1, -(-(total["size"] or 0) // (c * GROUP_CONTAINERS)), -(-total["n"] // GROUP_ITEMS))).cast("long").alias("groups"),
            )
            for n, c in usable
        )
    )
    each = items.select(
        "item_id",
        size.alias("whole"),
        F.xxhash64(F.coalesce("source", F.col("item_id").cast("string"))).alias("source"),
        F.coalesce("cluster", F.xxhash64("item_id")).alias("cluster"),
        F.explode(kinds).alias("k"),
    ).select("item_id", "whole", "source", "cluster", "k.*")
    full = F.floor(F.greatest(F.col("whole") - 1, F.lit(0)) / F.col("capacity")).cast("int")  # parts ahead of the last
    each = each.withColumn("ahead", full)
    parts = (
        each.where("ahead > 0")
        .select("container", "capacity", "item_id", F.explode(F.sequence(F.lit(1), "ahead")).alias("part_no"))
        .select(
            "container",
            "capacity",
            F.concat_ws("-", "container", F.lit("full"), F.col("item_id").cast("string"), F.col("part_no").cast("string")).alias("bin_id"),
            "item_id",
            "part_no",
            F.col("capacity").alias("size"),
            F.lit(False).alias("conflict"),
        )
    )

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        container, capacity, number = pdf["container"].iat[0], int(pdf["capacity"].iat[0]), int(pdf["grp"].iat[0])
        pdf = pdf.sort_values("item_id", kind="stable").reset_index(drop=True)
        where, clash = best_fit(pdf["size"].to_numpy(), pdf["source"].to_numpy(), pdf["cluster"].to_numpy(), capacity)
        return pd.DataFrame(
            {
                "container": container,
                "capacity": capacity,
                "bin_id": [f"{container}-{number}-{w}" for w in where],
                "item_id": pdf["item_id"],
                "part_no": pdf["part_no"],
                "size": pdf["size"],
                "conflict": clash,
            }
        )

    rest = each.select(
        "container",
        "capacity",
        F.pmod(F.xxhash64("item_id", "container"), F.col("groups")).alias("grp"),
        "item_id",
        (F.col("ahead") + 1).cast("int").alias("part_no"),
        (F.col("whole") - F.col("ahead") * F.col("capacity")).alias("size"),
        "source",
        "cluster",
    )
    return rest.groupBy("container", "grp").applyInPandas(group, schema).unionAll(parts.select(*[c.split()[0] for c in schema.split(", ")]))
