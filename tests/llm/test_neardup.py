import random

import numpy as np

from docmill.llm import golay, neardup


def test_golay_words_within_two_errors_share_a_codeword():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 23, 5000)
    flips = np.array([sum(1 << b for b in rng.choice(23, k, replace=False)) for k in rng.integers(0, 3, 5000)])
    (a, ma), (b, mb) = golay.codeword_keys(x), golay.codeword_keys(x ^ flips)
    shared = ((a[:, :, None] == b[:, None, :]) & ma[:, :, None] & mb[:, None, :]).any((1, 2))
    assert shared.all()
    assert set(ma.sum(1)) == {1, 6}


def brute(rows):
    sets = [(k, s, i, neardup.gram_sets([b])[0]) for k, s, i, b in rows]
    found = set()
    for n, (k, s, i, a) in enumerate(sets):
        for k2, s2, j, b in sets[:n]:
            if k == k2 and s == s2 and s is not None and i != j and neardup.similarity(a, b) >= 0.7:
                found.add((k, *sorted((i, j))))
    return found


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "기계전력수도안전" for b in "설비점검운전관리"] + ["valve", "pump", "hose"]
    rows = []
    for n in range(60):
        base = [rng.choice(words) for _ in range(60)]
        rows.append(("chunk", "", f"c{n:03d}", " ".join(base)))
        for m in range(2):
            edited = list(base)
            for _ in range(rng.randrange(1, 12)):
                edited[rng.randrange(60)] = rng.choice(words)
            rows.append(("chunk", "", f"c{n:03d}x{m}", "　".join(edited)))
            rows.append(("hit", f"q{n % 7}", f"h{n:03d}{m}", " ".join(edited)))
    rows += [("chunk", "", "null", None), ("chunk", "", "empty", ""), ("chunk", "", "short", "ab"), ("chunk", "", "short2", "ab"), ("hit", None, "lost", "x" * 50), ("hit", None, "lost2", "x" * 50)]
    rows += [("chunk", "", "copy1", "same text of some length"), ("chunk", "", "copy2", "same text of some length"), ("chunk", "", "copy2", "same text of some length")]
    rows += [("chunk", "", "long1", "가나다라마바사 " * 20000 + "a"), ("chunk", "", "long2", "가나다라마바사 " * 20000 + "b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "kind string, scope string, item_id string, body string, s1 string")
    got = {tuple(r) for r in neardup.similar_rows(df).collect()}
    want = brute(rows)
    assert got <= want
    assert len(got) >= 0.99 * len(want), sorted(want - got)
    assert ("chunk", "copy1", "copy2") in got and ("chunk", "long1", "long2") in got


def test_groups_and_empty_table(spark):
    a, b, c = "the valve is checked each year by the owner of the plant", "the valve is checked each year by the owner of the plants", "nothing in common with any other text here at all"
    df = spark.createDataFrame([("chunk", "", "1", a), ("chunk", "", "2", a), ("chunk", "", "3", b), ("chunk", "", "4", c)], "kind string, scope string, item_id string, body string")
    got = {r["item_id"]: r for r in neardup.grouped_rows(df).collect()}
    assert got["1"]["group"] == got["2"]["group"] == got["3"]["group"] != got["4"]["group"]
    assert (got["1"]["links"], got["1"]["copies"], got["4"]["links"]) == (1, 2, 0)
    assert neardup.similar_rows(df.limit(0)).count() == 0
