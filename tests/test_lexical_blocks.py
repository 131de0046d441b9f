import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.operators import lexical, retrieval

FIELDS, PHRASES = {"title": 3.0, "text": 1.0}, {"title": 4.0, "text": 2.0}


def tables(spark, rows=300, asked=40):
    rng = random.Random(5)
    words = [f"w{chr(97 + i)}" for i in range(12)] + ["운송보관", "手順"]
    said = lambda most: " ".join(rng.choice(words) for _ in range(rng.randrange(most)))
    texts = [(f"k{i:03d}", f"d{i % 37}" if i % 50 else None, said(4), None if i % 41 == 0 else said(30)) for i in range(rows)]
    texts += [(f"s{i:02d}", "same", "wa wb", "wa wb wc") for i in range(30)] + [(None, "none", "wa wb", "wa wb")]
    q = [(f"q{i}", said(6)) for i in range(asked)] + [("one", "wa"), ("pair", "wa wb"), ("twice", "wa wa wb"), ("foreign", "wa zzz"), ("none", "zzz"), ("null", None)]
    return spark.createDataFrame(texts, "id string, doc string, title string, text string").repartition(3), spark.createDataFrame(q, "query_id string, query string")


def plain(rows, queries):
    """Scores by the formula, over all pairs."""
    one = lambda c: X.terms(F.col(c))
    held = [(r["id"], r["doc"], {"title": r["a"] or [], "text": r["b"] or []}) for r in rows.select("id", "doc", one("title").alias("a"), one("text").alias("b")).collect()]
    avg = {f: np.mean([len(h[2][f]) for h in held if h[2][f]]) for f in FIELDS}
    df = {f: {} for f in FIELDS}
    for _, _, h in held:
        for f in FIELDS:
            for w in set(h[f]):
                df[f][w] = df[f].get(w, 0) + 1
    idf = lambda f, w: np.log(1 + (len(held) - df[f].get(w, 0) + 0.5) / (df[f].get(w, 0) + 0.5))
    norm = lambda x, n, f: x * 2.2 / (x + 1.2 * (0.25 + 0.75 * n / avg[f]))
    out = {}
    for q in queries.select("query_id", one("query").alias("t")).where("t is not null").collect():
        for key, doc, h in held:
            if not any(w in h[f] for w in q["t"] for f in FIELDS):
                continue
            s = {f: sum(FIELDS[f] * idf(f, w) * norm(h[f].count(w), len(h[f]), f) for w in sorted(set(q["t"])) if w in h[f]) for f in FIELDS}
            extra = [0.0]
            for f in FIELDS:
                if key is not None and all(w in h[f] for w in q["t"]):
                    at = [[p - i for p, w in enumerate(h[f]) if w == x] for i, x in enumerate(q["t"])]
                    widths = [max(min([x for x in own if x >= b], default=b + 3) - b for own in at) for b in {x for own in at for x in own}]
                    if freq := sum(1 / (1 + w) for w in widths if w <= 2):
                        extra.append(PHRASES[f] * sum(idf(f, w) for w in set(q["t"])) * norm(freq, len(h[f]), f))
            out[q["query_id"], key, doc] = 0.7 * max(s.values()) + 0.3 * sum(s.values()) + max(extra)
    return out


def test_scores_and_best_rows_are_those_of_all_pairs(spark):
    rows, queries = tables(spark)
    want = plain(rows, queries)
    every = retrieval.bm25(queries, rows, "id", FIELDS, phrases=PHRASES).collect()
    assert {(r["query_id"], r["id"]): r["score"] for r in every} == {(q, key): pytest.approx(s, abs=2e-6) for (q, key, _), s in want.items()}
    all_ = spark.createDataFrame([tuple(r) for r in every], "query_id string, id string, score double")
    got = retrieval.top(retrieval.bm25(queries, rows, "id", FIELDS, phrases=PHRASES, k=4), "id", 4)
    assert sorted(map(str, got.collect())) == sorted(map(str, retrieval.top(all_, "id", 4).collect()))
    columns = ["query_id", "doc", "id", "score", "rank"]
    by = retrieval.collapse(retrieval.bm25(queries, rows, "id", FIELDS, phrases=PHRASES, k=2, by="doc"), "id", "doc", 2).select(columns)
    docs = all_.join(rows.select("id", "doc"), all_["id"].eqNullSafe(rows["id"])).drop(rows["id"])
    assert sorted(map(str, by.collect())) == sorted(map(str, retrieval.collapse(docs, "id", "doc", 2).select(columns).collect()))


def test_scores_of_pairs_stay_in_the_tasks(spark):
    """What is written or shuffled grows with the questions, not with the pairs of questions and rows."""
    rows, queries = tables(spark, 900)
    pairs = retrieval.bm25(queries, rows, "id", FIELDS).count()
    given = retrieval.bm25(queries, rows, "id", FIELDS, k=3)
    assert 0 < given.count() <= 3 * queries.count() and pairs > 50 * given.count()
    assert "Exchange" not in given._jdf.queryExecution().executedPlan().toString()


def test_queries_without_rows_and_rows_without_terms(spark):
    rows, queries = tables(spark, 5, 2)
    assert retrieval.bm25(queries, rows.limit(0), "id", FIELDS, phrases=PHRASES, k=3).count() == 0
    assert retrieval.bm25(queries.limit(0), rows, "id", FIELDS, phrases=PHRASES, k=3).count() == 0
    assert retrieval.bm25(queries, rows.withColumn("title", F.lit(None).cast("string")).withColumn("text", F.lit("")), "id", FIELDS, k=3).count() == 0


def test_a_share_of_questions_meets_a_block_of_rows_once(monkeypatch):
    """Each pair of blocks carries the block of rows, so a batch of questions is one block."""
    monkeypatch.setattr(lexical, "task_number", int)
    asked = pa.RecordBatch.from_arrays([pa.array([f"q{i}" for i in range(9000)])], names=["query_id"])
    assert len(list(lexical.pack_queries(iter([asked])))) == 1


def test_phrases_are_looked_for_where_they_can_count(monkeypatch):
    """Rows that hold the terms in different fields, and those whose phrase can't reach the best, have no places compared."""
    monkeypatch.setattr(lexical, "task_number", int)
    asked = pa.RecordBatch.from_pylist(
        [{"query_id": "q", "asked": [{"term": t, "idf_0": 1.0, "idf_1": 1.0} for t in ("a", "b")], "lists": [["a", "b"]], "n_terms": 2}]
    )
    q = lexical.Asked(next(iter(lexical.pack_queries(iter([asked])))).column("queries")[0].as_buffer(), 2, {0: 4.0, 1: 2.0})
    rows = [{"key": f"k{i:03d}", "by": None, "terms_0": ["a", "b"] if i < 5 else ["a"], "terms_1": ["b"] if i < 105 else ["a", *"xyz", "b"]} for i in range(200)]
    kinds = pa.schema([("key", pa.string()), ("by", pa.string()), ("terms_0", pa.list_(pa.string())), ("terms_1", pa.list_(pa.string()))])
    block = next(lexical.pack_rows(2)(iter([pa.RecordBatch.from_pylist(rows, schema=kinds)])))
    compared, count = [], lexical.Meeting.frequency
    monkeypatch.setattr(lexical.Meeting, "frequency", lambda self, f, qi, di: compared.extend(di) or count(self, f, qi, di))
    for _ in range(2):
        compared.clear()
        lexical.Meeting(q, lexical.Rows(block, 0, 2, False), [3.0, 1.0], [1.0, 2.0]).keep_best(3, False)
    assert sorted(compared) == [0, 1, 2, 3, 4]
    assert set(q.best[0][3]) >= {"k000", "k001", "k002"} and not {"k005", "k199"} & set(q.best[0][3])


def test_pairs_of_blocks_reach_python_one_by_one(spark, monkeypatch):
    kernel = lexical.meet

    def counted(*args):
        work = kernel(*args)

        def one_by_one(batches):
            def each():
                for b in batches:
                    assert b.num_rows == 1
                    yield b

            return work(each())

        return one_by_one

    monkeypatch.setattr(lexical, "meet", counted)
    rows = spark.createDataFrame([(f"r{i:02d}", f"word{i % 5} common") for i in range(40)], "chunk_id string, title string").repartition(4)  # four blocks
    asked = spark.createDataFrame([("q1", "word1 common"), ("q2", "word3")], "query_id string, query string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for before in (None, "500"):
        if before:
            spark.conf.set(name, before)
        got = retrieval.bm25(asked, rows, "chunk_id", {"title": 1.0}, k=3)
        assert retrieval.top(got, "chunk_id", 3).where("query_id = 'q2'").select("chunk_id").collect() == [("r03",), ("r08",), ("r13",)]
        assert spark.conf.get(name, None) == before
    spark.conf.unset(name)
