"""Features of hits are taken from whole texts, wherever in them the words of a question are."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from docmill.operators import evaluation
from docmill.plans import registry

FOLDER, FILLER = Path("/root/testdata/sf0.001"), "ㅋ" * 1300  # a letter that no question has


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The smallest tables with a filler ahead of each body, and with it behind."""
    made = []
    for name, body in (("ahead", F.concat(F.lit(FILLER), "body")), ("behind", F.concat("body", F.lit(FILLER)))):
        folder = tmp_path_factory.mktemp(name)
        for table in FOLDER.iterdir():
            if table.stem != "chunks":
                (folder / table.name).symlink_to(table)
        spark.read.parquet(str(FOLDER / "chunks.parquet")).withColumn("body", body).coalesce(1).write.parquet(str(folder / "chunks.parquet"))
        made.append(folder)
    return made


def by_hit(rows) -> dict:
    return {(r["query_id"], r["chunk_id"]): r for r in rows}


def test_body_gram_of_a_long_body(spark):
    asked = "제동 거리의 측정 방법"
    bodies = {"start": asked + FILLER, "end": FILLER + asked, "across": "ㅋ" * 1196 + asked, "far": "ㅋ" * 30_000 + asked, "half": FILLER + "제동 거리", "none": FILLER, "null": None, "empty": ""}
    hits = spark.createDataFrame(
        [("q", asked, c, "d", 1, 2.0, 1, 0.5, b, b, 2, 100) for c, b in bodies.items()],
        "query_id string, query string, chunk_id string, doc_id string, bm25_rank int, bm25_score double, knn_rank int, knn_score double, title string, body string, depth int, token_len int",
    )
    got = {r["chunk_id"]: (r["title_gram"], r["body_gram"]) for r in evaluation.rank_features(hits).collect()}
    half = round(2 / 7, 6)
    assert got == {"start": (1.0, 1.0), "end": (1.0, 1.0), "across": (1.0, 1.0), "far": (1.0, 1.0), "half": (half, half), "none": (0.0, 0.0), "null": (0.0, 0.0), "empty": (0.0, 0.0)}


def test_rank_features_and_their_sql_use_whole_bodies(spark, folders):
    db = duckdb.connect()
    for table in folders[0].iterdir():
        files = f"{table}/*.parquet" if table.is_dir() else str(table)
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{files}')")
    result = db.execute(registry.ORACLES["rank_features"])
    names = [c[0] for c in result.description]
    want = by_hit(dict(zip(names, row)) for row in result.fetchall())
    got = by_hit(r.asDict() for r in registry.QUERIES["rank_features"](spark, str(folders[0])).collect())
    assert got.keys() == want.keys()
    assert all(got[k][c] == pytest.approx(want[k][c], abs=2e-6) for k in got for c in evaluation.FEATURES)
    assert sum(r["body_gram"] > 0 for r in got.values()) > 5  # none if only the beginning is read


def test_learned_rerank_uses_whole_bodies(spark, folders):
    """A filler has the same effect ahead of a body as behind it."""
    ahead, behind = (by_hit(registry.QUERIES["learned_rerank"](spark, str(f)).collect()) for f in folders)
    assert ahead.keys() == behind.keys()
    assert all(ahead[k]["ltr_score"] == pytest.approx(behind[k]["ltr_score"], abs=2e-6) and ahead[k]["label"] == behind[k]["label"] for k in ahead)
