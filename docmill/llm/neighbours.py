"""The k most similar vectors of every vector: NN-descent as Spark joins.

1. Start: the vectors are sorted a few times by the signs of random projections about the mean and compared within small
   blocks of the sorted order. Blocks are bounded and ties are spread by a salt, so a value that a third of all rows share is no hot group.
2. Descent: around every vector stands a circle, a bounded random sample of its close neighbours, forward and reverse. The vectors of a
   circle's members are sent to it once and compared there; a pair is looked at only if one of the two is new to the circle. What is better
   than a vector's worst neighbour goes back to it. Rounds go on until less than :data:`STILL` of the lists gain a close neighbour.
3. :func:`greedy_search` answers queries by walking the finished graph, one join per hop, until the beams rest.

Vectors travel as 16-bit numbers with a scale; a cosine from these is off by 1e-5 or so. The result is approximate; recall is
measured against brute force in the tests and, for the larger tables, in the README.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.sources.tables import discard, materialize

#: Sorted orders, sign bits per order, vectors per block, neighbours that a block gives, neighbours kept.
ORDERS, BITS, BLOCK, GIVEN, KEEP = 4, 24, 1024, 6, 10
#: Closest neighbours that a vector is introduced to, and members of a circle.
FORWARD, CIRCLE = 8, 13
#: Share of the lists that may still gain one of their closest FIRST neighbours in the last round; rounds and hops at most.
STILL, FIRST, ROUNDS, HOPS = 0.001, 5, 30, 30
#: Vectors of each kind, drawn by hash, among which a search looks for its entry.
ENTRIES = 2048

#: A list: partners ``to``, best first, their cosines, and whether the last round brought them. Ahead of merging, one row for each.
GRAPH = "vid long, sim array<float>, to array<long>, fresh array<boolean>"
FOUND = "vid long, to long, sim float, fresh boolean"
_NEAR = pa.list_(pa.struct([("sim", pa.float64()), ("vid", pa.int64())]))
Batches = Iterator[pa.RecordBatch]


def usable_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """(kind, key, vector): vectors of ``dim`` finite numbers, not all zero; a repeated key once."""
    ok = (
        (F.size("vector") == dim)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    return rows.select("kind", "key", "vector").where(ok).dropDuplicates(["kind", "key"])


def _units(b: pa.RecordBatch, dim: int) -> np.ndarray:
    v = b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _packed(unit: np.ndarray) -> pa.Array:
    """Unit vectors as bytes: a scale and 16-bit numbers."""
    scale = (np.abs(unit).max(1, keepdims=True) / 32767).astype("<f4")
    short = np.round(unit / scale).astype("<i2")
    whole = np.concatenate([scale.view(np.uint8), short.view(np.uint8).reshape(len(unit), -1)], axis=1)
    return pa.array([x.tobytes() for x in whole], type=pa.binary())


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as doubles (their sums of products are exact, in any order) and scales."""
    whole = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    scale = np.ascontiguousarray(whole[:, :4]).view("<f4")[:, 0].astype(np.float64)
    return np.ascontiguousarray(whole[:, 4:]).view("<i2").astype(np.float64), scale


def _means(rows: DataFrame, dim: int) -> dict[str, np.ndarray]:
    """Mean unit vector of each kind; summed in the tasks, then by position: a few rows reach the driver."""

    def sums(batches: Batches) -> Batches:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            v = _units(b, dim)
            kinds = b.column("kind").to_numpy(zero_copy_only=False)
            for k in set(kinds):
                own = v[kinds == k]
                total[k] = total.get(k, 0) + np.append(own.sum(0), len(own))
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([t.tolist() for t in total.values()])], names=["kind", "total"])

    parts = rows.select("kind", "vector").mapInArrow(sums, "kind string, total array<double>")
    found: dict[str, np.ndarray] = {}
    for r in parts.select("kind", F.posexplode("total")).groupBy("kind", "pos").agg(F.sum("col").alias("x")).collect():
        found.setdefault(r["kind"], np.zeros(dim + 1))[r["pos"]] = r["x"]
    return {k: t[:-1] / t[-1] for k, t in found.items()}


def index_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """Written table (vid, kind, key, unit, marks) of the usable vectors of (kind, key, vector)."""
    rows = materialize(usable_vectors(rows, dim), "vectors")
    means = _means(rows, dim)
    planes = np.random.Generator(np.random.PCG64(7)).standard_normal((dim, ORDERS * BITS))
    weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def mark(batches: Batches) -> Batches:
        for b in batches:
            v = _units(b, dim)
            side = (v - np.stack([means[k] for k in b.column("kind").to_pylist()]).reshape(len(v), dim)) @ planes > 0
            marks = (side.reshape(len(v), ORDERS, BITS) * weight).sum(2)
            yield pa.RecordBatch.from_arrays(
                [b.column("kind"), b.column("key"), _packed(v), pa.array(marks.tolist(), type=pa.list_(pa.int64()))],
                names=["kind", "key", "unit", "marks"],
            )

    marked = rows.mapInArrow(mark, "kind string, key string, unit binary, marks array<long>")
    written = materialize(marked.withColumn("vid", F.monotonically_increasing_id()), "marked")
    discard(rows)
    return written


def _top(near: Column, keep: int, of: str = "vid") -> Column:
    """The best ``keep`` of an array of (sim, vid), each once; equal ones by a hash that differs from vector to vector, so ties make no hubs."""
    order = F.array_sort(F.transform(F.array_distinct(near), lambda n: F.struct((-n["sim"]).alias("s"), F.xxhash64(of, n["vid"]).alias("h"), n["vid"].alias("vid"))))
    return F.transform(F.slice(order, 1, keep), lambda n: F.struct((-n["s"]).alias("sim"), n["vid"].alias("vid")))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two ids: equal cosines go by it, so ties make no vector everyone's neighbour."""
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ b.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _best(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, keep: int, fresh: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The best ``keep`` partners of each owner in order, each partner once (if it is given as fresh and not fresh, it is not)."""
    sim = sim.astype(np.float32)
    fresh = np.ones(len(owner), dtype=bool) if fresh is None else fresh
    order = np.lexsort((fresh, _mixed(owner, other), -sim, owner))
    owner, other, sim, fresh = (x[order] for x in (owner, other, sim, fresh))
    once = np.append(True, (np.diff(owner) != 0) | (np.diff(other) != 0))[: len(owner)]
    owner, other, sim, fresh = (x[once] for x in (owner, other, sim, fresh))
    head = np.flatnonzero(np.append(True, np.diff(owner) != 0)[: len(owner)])
    best = np.arange(len(owner)) - np.repeat(head, np.diff(np.append(head, len(owner)))) < keep
    return tuple(x[best] for x in (owner, other, sim, fresh))


def _rows(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, keep: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in _best(owner, other, sim, keep)], names=["vid", "to", "sim", "fresh"])


def _whole_groups(key: str, run: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Batches], Batches]:
    """Applies ``run`` to a stream sorted by ``key``, never parting the rows of one key."""

    def each(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key).to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if last or (held and held[-1].column(key)[-1].as_py() != keys[0]):
                yield run(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield run(pa.Table.from_batches(held))

    return each


def _merged(found: DataFrame, keep: int) -> DataFrame:
    """One list of each vector. The steps before give at most ``keep`` rows of a vector in a batch, so no vector has unboundedly many."""

    def merge(table: pa.Table) -> pa.RecordBatch:
        owner, other, sim, fresh = _best(*(table.column(c).to_numpy() for c in ("vid", "to", "sim")), keep, table.column("fresh").to_numpy())
        head = np.flatnonzero(np.append(True, np.diff(owner) != 0)[: len(owner)])
        ends = pa.array(np.append(head, len(owner)).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(owner[head]), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (sim, other, fresh))], names=["vid", "sim", "to", "fresh"])

    return found.select("vid", "to", "sim", "fresh").repartition("vid").sortWithinPartitions("vid").mapInArrow(_whole_groups("vid", merge), GRAPH)


def _in_blocks(block: int, keep: int) -> Callable[[Batches], Batches]:
    """Neighbours within blocks of a sorted stream of (kind, vid, unit)."""

    def compare(table: pa.Table) -> Batches:
        kinds, vid = table.column("kind").to_numpy(), table.column("vid").to_numpy()
        whole, scale = _unpacked(table.column("unit"))
        for k in dict.fromkeys(kinds):
            own = np.flatnonzero(kinds == k)
            if len(own) < 2:
                continue
            v, s, ids = whole[own], scale[own], vid[own]
            sim = (v @ v.T) * (s[:, None] * s)
            np.fill_diagonal(sim, -2)
            most = min(keep, len(own) - 1)
            best = np.argpartition(-sim, most - 1, axis=1)[:, :most]
            yield _rows(np.repeat(ids, most), ids[best].ravel(), np.take_along_axis(sim, best, 1).ravel(), most)

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= 2 * block:
                table, start = pa.Table.from_batches(held), 0
                while count - start >= 2 * block:
                    yield from compare(table.slice(start, block))
                    start += block
                held, count = table.slice(start).to_batches(), count - start
        if count:
            yield from compare(pa.Table.from_batches(held))

    return run


def first_graph(vectors: DataFrame, orders: int = ORDERS, block: int = BLOCK, keep: int = KEEP) -> DataFrame:
    """Lists of the neighbours found within blocks of the first sorted orders."""
    found = None
    for t in range(orders):
        part = (
            vectors.select("kind", "vid", "unit", F.col("marks")[t].alias("mark"), F.xxhash64("vid").alias("salt"))
            .repartitionByRange("kind", "mark", "salt")
            .sortWithinPartitions("kind", "mark", "salt")
            .select("kind", "vid", "unit")
            .mapInArrow(_in_blocks(block, min(keep, GIVEN)), FOUND)
        )
        found = part if found is None else found.unionAll(part)
    return _merged(found, keep)


def _introduce(circle: int, keep: int) -> Callable[[Batches], Batches]:
    """Compares the members of each circle in a stream sorted by centre. Of each batch a vector gets its best partners alone, so
    what later meets at one vector is bounded by the number of batches, not of circles."""

    def compare(table: pa.Table) -> pa.RecordBatch:
        centre, vid = table.column("centre").to_numpy(), table.column("member").to_numpy()
        fresh, worst = table.column("fresh").to_numpy(), table.column("worst").to_numpy()
        whole, scale = _unpacked(table.column("unit"))
        head = np.flatnonzero(np.append(True, np.diff(centre) != 0))
        size = np.diff(np.append(head, len(centre)))
        group, place = np.repeat(np.arange(len(head)), size), np.arange(len(centre)) - np.repeat(head, size)
        shape = (len(head), circle)
        at = np.full(shape, -1)
        at[group, place] = np.arange(len(centre))
        v = np.zeros((*shape, whole.shape[1]))
        v[group, place] = whole
        there = at >= 0
        new = there & fresh[at]
        dots = v @ v.transpose(0, 2, 1)
        g, i, j = np.nonzero(there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]) & ~np.eye(circle, dtype=bool))
        a, b = at[g, i], at[g, j]
        sim = dots[g, i, j] * (scale[a] * scale[b])
        better = sim > worst[a]
        return _rows(vid[a[better]], vid[b[better]], sim[better], keep)

    return _whole_groups("centre", compare)


def descend(graph: DataFrame, units: DataFrame, turn: int, forward: int = FORWARD, circle: int = CIRCLE, keep: int = KEEP) -> DataFrame:
    """One round of NN-descent on a written graph."""
    one = graph.select("vid", F.posexplode(F.slice("to", 1, forward)).alias("at", "to"), F.col("fresh").alias("all")).select("vid", "to", F.col("all")[F.col("at")].alias("fresh"))
    both = one.unionAll(one.select(F.col("to").alias("vid"), F.col("vid").alias("to"), "fresh"))
    # a random sample; the two directions of one edge share their rank
    order = Window.partitionBy("vid").orderBy(F.xxhash64("to", F.lit(turn)), "to")
    circles = (
        both.withColumn("at", F.dense_rank().over(order))
        .where(F.col("at") <= circle)
        .groupBy("vid", "to").agg(F.max("fresh").alias("fresh"))
        .withColumn("any", F.max("fresh").over(Window.partitionBy("vid")))
        .where("any")
        .select(F.col("vid").alias("centre"), F.col("to").alias("member"), "fresh")
    )
    # a list that is not full takes whatever comes
    worst = graph.select("vid", F.when(F.size("to") >= keep, F.element_at("sim", -1).cast("double")).otherwise(-2.0).alias("worst"))
    found = (
        circles.join(units.join(worst, "vid").withColumnRenamed("vid", "member"), "member")
        .select("centre", "member", "fresh", "worst", "unit")
        .repartition("centre")
        .sortWithinPartitions("centre")
        .mapInArrow(_introduce(circle, keep), FOUND)
    )
    held = graph.select("vid", F.inline(F.arrays_zip("to", "sim"))).withColumn("fresh", F.lit(False))
    return _merged(held.unionByName(found), keep)


def _complete(graph: DataFrame, vectors: DataFrame, keep: int) -> DataFrame:
    """Vectors whose list is shorter than their kind allows (few of a kind, parted by the edges of the sorted partitions) are compared
    with all of their kind. Everything else has a full list from its block, so this is no step for many."""
    sizes = vectors.groupBy("kind").agg(F.count("*").alias("n"))
    joined = vectors.select("vid", "kind").join(graph.select("vid", F.size("to").alias("has")), "vid", "left").join(sizes, "kind")
    short = materialize(joined.where(F.coalesce("has", F.lit(0)) < F.least(F.lit(keep), F.col("n") - 1)).select("vid", "kind"), "short")
    if not short.limit(1).count():
        return graph
    a = short.join(vectors.select("vid", F.col("unit").alias("x")), "vid").select("kind", F.col("vid").alias("a"), "x")
    pairs = a.join(vectors.select("kind", F.col("vid").alias("b"), F.col("unit").alias("y")), "kind").where("a <> b").select("a", "b", "x", "y")
    rest = graph.join(short.select("vid"), "vid", "left_anti")
    more = scored(pairs).select(F.col("a").alias("vid"), F.col("b").alias("to"), F.col("sim").cast("float").alias("sim"), F.lit(True).alias("fresh"))
    return rest.unionAll(_merged(more, keep))


def scored(pairs: DataFrame, a: str = "a", kind: str = "long") -> DataFrame:
    """(a, b, x, y) as (a, b, sim): cosines of the packed vectors x and y."""

    def dot(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                (x, s), (y, t) = _unpacked(b.column("x")), _unpacked(b.column("y"))
                yield pa.RecordBatch.from_arrays([b.column(a), b.column("b"), pa.array((x * y).sum(1) * (s * t))], names=[a, "b", "sim"])

    return pairs.select(a, "b", "x", "y").mapInArrow(dot, f"{a} {kind}, b long, sim double")


def neighbour_graph(vectors: DataFrame, orders: int = ORDERS, block: int = BLOCK, keep: int = KEEP, forward: int = FORWARD, circle: int = CIRCLE, still: float = STILL, rounds: int = ROUNDS) -> DataFrame:
    """The finished graph (vid, near), best first, of a table that :func:`index_vectors` wrote.

    Vectors of different kinds are never neighbours. A vector alone in its kind has no row. Rounds end when at most
    ``still`` of the lists gained one of their closest neighbours.
    """
    graph = materialize(first_graph(vectors, orders, block, keep), "graph")
    start = _complete(graph, vectors, min(FIRST, keep))
    if start is not graph:
        start = materialize(start, "graph")
        discard(graph)
    graph, units = start, vectors.select("vid", "unit")
    for turn in range(rounds):
        after = materialize(descend(graph, units, turn, forward, circle, keep), "graph")
        discard(graph)
        graph = after
        n = graph.agg(F.count("*").alias("n"), F.count_if(F.exists(F.slice("fresh", 1, FIRST), lambda f: f)).alias("gained")).first()
        if n["gained"] <= still * n["n"]:
            break
    return graph.select("vid", F.arrays_zip(F.col("sim"), F.col("to").alias("vid")).alias("near"))


def greedy_search(queries: DataFrame, graph: DataFrame, vectors: DataFrame, k: int = 5, beam: int = 16, entries: int = ENTRIES, hops: int = HOPS) -> DataFrame:
    """The k nearest of each query (kind, query, unit), found by walking the graph: kind, query, near.

    A query enters at the best of ``entries`` vectors of its kind, drawn by hash: a bounded table that every task gets. Each hop joins the
    members of the beam that have not been left yet with the graph's edges, forward and reverse, scores whoever is new and keeps the
    best; it ends when no beam changes. ``unit`` is as in the index. A kind without vectors gives no row.
    """
    drawn = Window.partitionBy("kind").orderBy(F.xxhash64("vid"), "vid")
    sample = vectors.select("kind", "vid", "unit").withColumn("at", F.row_number().over(drawn)).where(F.col("at") <= entries).drop("at").collect()
    doors: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for kind in {r["kind"] for r in sample}:
        own = [r for r in sample if r["kind"] == kind]
        doors[kind] = (np.array([r["vid"] for r in own]), *_unpacked(pa.array([bytes(r["unit"]) for r in own], type=pa.binary())))

    def enter(batches: Batches) -> Batches:
        for b in batches:
            kinds = b.column("kind").to_numpy(zero_copy_only=False)
            for kind in set(kinds) & set(doors):
                own = np.flatnonzero(kinds == kind)
                vid, whole, scale = doors[kind]
                v, s = _unpacked(b.column("unit").take(pa.array(own)))
                sim = (v @ whole.T) * (s[:, None] * scale)
                most = min(beam, len(vid))
                best = np.argpartition(-sim, most - 1, axis=1)[:, :most]
                lists = [[{"sim": sim[i, j], "vid": vid[j]} for j in row] for i, row in enumerate(best)]
                yield pa.RecordBatch.from_arrays([b.column("kind").take(pa.array(own)), b.column("query").take(pa.array(own)), pa.array(lists, type=_NEAR)], names=["kind", "query", "near"])

    edges = graph.select("vid", F.explode(F.col("near")["vid"]).alias("to"))
    ways = materialize(edges.unionAll(edges.select("to", "vid")).distinct(), "ways")
    asked = queries.select("query", F.col("unit").alias("x"))
    entered = queries.select("kind", "query", "unit").mapInArrow(enter, "kind string, query string, near array<struct<sim: double, vid: long>>")
    state = materialize(entered.select("kind", "query", _top(F.col("near"), beam, "query").alias("near"), F.array().cast("array<long>").alias("left")), "beam")
    for _ in range(hops):
        at = state.select("query", F.explode(F.array_except(F.col("near")["vid"], "left")).alias("vid"))
        pairs = at.join(ways, "vid").select("query", F.col("to").alias("b")).distinct()
        full = pairs.join(asked, "query").join(vectors.select(F.col("vid").alias("b"), F.col("unit").alias("y")), "b")
        new = scored(full, "query", "string")
        # of each query the best of a hop alone
        fit = new.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "b"))).where(F.col("at") <= beam)
        met = fit.groupBy("query").agg(F.collect_list(F.struct("sim", F.col("b").alias("vid"))).alias("met"))
        step = state.join(met, "query", "left").select(
            "kind",
            "query",
            _top(F.concat("near", F.coalesce("met", F.array().cast("array<struct<sim: double, vid: long>>"))), beam, "query").alias("near"),
            F.array_union("left", F.col("near")["vid"]).alias("left"),
        )
        after = materialize(step, "beam")
        discard(state)
        state = after
        if not state.where(F.size(F.array_except(F.col("near")["vid"], "left")) > 0).limit(1).count():
            break
    discard(ways)
    return state.select("kind", "query", F.slice("near", 1, k).alias("near"))


def similar_vectors(rows: DataFrame, dim: int, k: int = 5) -> DataFrame:
    """For every usable vector of (kind, key, vector) its k nearest: kind, key, rank, other, cosine."""
    if k > KEEP:
        raise ValueError(f"at most {KEEP} neighbours are kept")
    vectors = index_vectors(rows, dim)
    graph = neighbour_graph(vectors)
    names = vectors.select("vid", "key", "kind")
    return (
        graph.select("vid", F.posexplode(F.slice("near", 1, k)).alias("p", "n"))
        .select("vid", (F.col("p") + 1).alias("rank"), F.col("n.vid").alias("to"), F.col("n.sim").alias("cosine"))
        .join(names, "vid")
        .join(names.select(F.col("vid").alias("to"), F.col("key").alias("other")), "to")
        .select("kind", "key", "rank", "other", "cosine")
    )
