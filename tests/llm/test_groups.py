import random

from docmill.llm.groups import connected


def test_a_long_chain_in_any_order_is_one_group(spark):
    path = list(range(1, 1001))
    random.Random(7).shuffle(path)
    pairs = [(min(a, b), max(a, b)) for a, b in zip(path, path[1:])] + [(2001, 2002), (2002, 2003), (2001, 2002)]
    nodes = spark.createDataFrame([(i,) for i in [*path, 2001, 2002, 2003, 3000, 3000]], "tid long")
    got = {r["tid"]: r["group"] for r in connected(nodes, spark.createDataFrame(pairs, "tid_a long, tid_b long")).collect()}
    assert got == {i: 1 for i in path} | {2001: 2001, 2002: 2001, 2003: 2001, 3000: 3000}


def test_without_pairs_each_node_is_its_own_group(spark):
    nodes = spark.createDataFrame([(5,), (6,)], "tid long")
    pairs = spark.createDataFrame([], "tid_a long, tid_b long")
    assert sorted(map(tuple, connected(nodes, pairs).collect())) == [(5, 5), (6, 6)]
