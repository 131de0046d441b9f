import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import neighbours as N


def table(spark, n=3000, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 10, dim))
    v = np.repeat(centres, 10, 0) + 0.6 * rng.standard_normal((n // 10 * 10, dim))
    rows = [("chunk", f"c{i:05d}", [float(x) for x in r], 0) for i, r in enumerate(v)]
    return v, spark.createDataFrame(rows, "kind string, key string, vector array<float>, unit int")


def best_of(v, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    return np.argsort(-sim, 1)[:, :k]


@pytest.fixture(scope="module")
def small(spark):
    v, df = table(spark)
    return v, df, N.index_vectors(df, 16)


def recall(v, index, graph):
    place = {r["vid"]: int(r["key"][1:]) for r in index.select("vid", "key").collect()}
    best = best_of(v, 5)
    hit = sum(len({place[n["vid"]] for n in r["near"][:5]} & set(best[place[r["vid"]]])) for r in graph.collect())
    return hit / (5 * len(v))


def test_descent_lifts_a_poor_start(spark, small):
    v, _, index = small
    start = recall(v, index, N.neighbour_graph(index, orders=2, block=16, rounds=0))
    end = recall(v, index, N.neighbour_graph(index, orders=2, block=16))
    assert start < 0.35 and end >= 0.95


def test_recall_against_brute_force(spark, small):
    v, df, _ = small
    got = {(r["key"], r["other"]): r["cosine"] for r in N.similar_vectors(df, 16).collect()}
    best = best_of(v, 5)
    want = {(f"c{i:05d}", f"c{j:05d}") for i in range(len(v)) for j in best[i]}
    assert len(got.keys() & want) >= 0.98 * len(want) and len(got) == len(want)
    u = v.astype("f4") / np.linalg.norm(v.astype("f4"), axis=1, keepdims=True)
    assert all(abs(u[int(a[1:])] @ u[int(b[1:])] - c) < 5e-5 for (a, b), c in got.items())


def test_greedy_search(spark, small):
    v, _, index = small
    graph = N.neighbour_graph(index)
    asked = index.where("vid % 20 = 0").select("kind", F.col("key").alias("query"), "unit")
    found = N.greedy_search(asked, graph, index, k=6, entries=32)
    key = {r["vid"]: r["key"] for r in index.select("vid", "key").collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = total = 0
    for r in found.collect():
        mine = np.argsort(-(u @ u[int(r["query"][1:])]))[:6]
        hit += len({f"c{j:05d}" for j in mine} & {key[n["vid"]] for n in r["near"]})
        total += 6
    assert total and hit >= 0.95 * total


def test_a_third_equal(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((900, 8))
    v[:300] = v[0]
    rows = [("chunk", f"c{i}", [float(x) for x in r]) for i, r in enumerate(v)]
    found = N.similar_vectors(spark.createDataFrame(rows, "kind string, key string, vector array<float>"), 8).collect()
    assert len(found) == 900 * 5
    mine = [r for r in found if int(r["key"][1:]) < 300]
    assert all(r["cosine"] > 0.9999 for r in mine)
    often = max(np.unique([r["other"] for r in mine], return_counts=True)[1])
    assert often < 100  # ties are spread, no vector is everyone's neighbour


def test_unusable_repeated_and_few(spark):
    rows = [("a", "1", [1.0, 0.0]), ("a", "1", [1.0, 0.0]), ("a", "2", [0.9, 0.1]), ("a", "3", None), ("a", "4", [0.0, 0.0]), ("a", "5", [1.0]), ("a", "6", [float("nan"), 1.0]), ("b", "7", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "kind string, key string, vector array<float>")
    assert {(r["key"], r["other"]) for r in N.similar_vectors(df, 2).collect()} == {("1", "2"), ("2", "1")}
    assert N.similar_vectors(df.limit(0), 2).count() == 0
