import os

import numpy as np
import pytest

from docmill.llm import packing, stuffing, tokenizing

needs_files = pytest.mark.skipif(not os.path.exists(tokenizing.rank_file()), reason="no tokenizer files")


@needs_files
def test_ids_equal_the_public_library(spark):
    import tiktoken

    ranks = tokenizing.load_ranks(tokenizing.rank_file())
    public = tiktoken.Encoding("own", pat_str=tokenizing.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    texts = ["", None, "Hello, world! It's 12 o'clock", "연차휴가는 매년 사용하여야 한다.", "a" * 5000, " \n\t  x", "<|endoftext|>", "가나" * 1500, "👩‍👩‍👧 ½", "abab" * 400]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokenizing.encode_column(df, "text", ["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == [public.encode_ordinary(t) if t else [] for t in texts]
    counts = {r["doc_id"]: r["tokens"] for r in tokenizing.count_column(df, "text", ["doc_id"]).collect()}
    assert all(counts[i] == len(got[i]) for i in counts)
    assert tokenizing.encode_column(df.limit(0), "text", ["doc_id"]).count() == 0


def test_packing(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(0, 300, 600)] + [0, None, 1700, 500, 1000]
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 40}", None if i % 5 else 7, s) for i, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "item_id long, source string, cluster long, size long")
    got = packing.pack(df, {"small": 500, "large": 2000, "none": None, "bad": 0}).toPandas()
    for name, cap in (("small", 500), ("large", 2000)):
        g = got[got.container == name]
        assert g.groupby("bin_id")["size"].sum().max() <= cap
        assert g.groupby("item_id")["size"].sum().tolist() == [s or 0 for s in sizes]
        assert (g.groupby("item_id").size() == [max(1, -(-(s or 0) // cap)) for s in sizes]).all()
        bins = g.bin_id.nunique()
        assert bins <= -(-sum(s or 0 for s in sizes) // cap) * 1.02 + 2
    assert set(got.container) == {"small", "large"}
    assert packing.pack(df.limit(0), {"small": 500}).count() == 0


def test_conflicts_are_avoided_where_there_is_room():
    where, clash = packing.best_fit(np.array([6, 6, 4, 4]), np.array([1, 2, 1, 2]), np.array([10, 11, 12, 13]), 10)
    assert where[0] != where[2] and where[1] != where[3] and not clash.any()


SALAD = "valve sale valve price valve cheap valve offer valve valve discount. valve store valve buy valve "
PROSE = ["Staff may not enter the plant without a written permit from the owner.", "The annual report describes how many drawings were kept with every manual.", "Before winter begins, somebody drains the pipes and checks each joint carefully."]


def test_stuffed_pages(spark):
    texts = [SALAD * 5, "\n".join(PROSE), "\n".join(PROSE) + "\n#valve #pump", "\n".join(f"https://site-{i}.example/item/{i}" for i in range(20)), None, "", "   ", "\n".join(f"{a} ..... {i}" for i, a in enumerate("alpha beta gamma delta epsilon zeta eta theta".split())), (PROSE[0] + "\n") + SALAD * 6]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, share double")
    got = {r["doc_id"] for r in stuffing.stuffed_share(df, "doc_id", "text").where("share > 0.5").collect()}
    assert got == {0, 3, 8}
    assert stuffing.stuffed_share(df.limit(0), "doc_id", "text").count() == 0


def test_conflicts_are_only_those_that_must_be():
    rng = np.random.default_rng(5)
    sizes = rng.integers(50, 1500, 3000)
    sources = np.where(np.arange(3000) % 3 == 0, 0, rng.integers(1, 200, 3000))  # a third of one source
    clusters = np.where(np.arange(3000) % 10 == 0, rng.integers(10**6, 10**6 + 40, 3000), np.arange(3000))
    for cap in (1500, 8192):
        where, clash = packing.best_fit(sizes, sources, clusters, cap)
        assert np.bincount(where, weights=sizes).max() <= cap
        needed = -(-int(sizes.sum()) // cap)
        assert where.max() + 1 <= needed * 1.03 + 2
        for names in (sources, clusters):
            pairs, count = np.unique(np.stack([where, names]), axis=1, return_counts=True)
            of, total = np.unique(names, return_counts=True)
            most = -(-total // needed)
            assert (count <= most[np.searchsorted(of, pairs[1])]).all()
        assert clash.sum() == 0 if cap == 1500 else clash.sum() <= 1000 - needed * 0.5
