from docmill.llm import splitting


def pieces(spark, text, limit, overlap, tokens=None):
    df = spark.createDataFrame([(text, 1)], "body string, n_pieces int")
    s = splitting.split_items(df, "body", limit, overlap, tokens).drop("n_pieces")
    return [(r["piece"], r["shared"]) for r in splitting.explode_pieces(s).orderBy("piece_no").collect()]


def test_nothing_is_lost_and_limits_hold(spark):
    texts = [
        "가나다. " * 500,
        "word " * 900,
        "x" * 5000,
        "line\r\n" * 700,
        "\n\n".join("Sentence one. Sentence two! 세 번째 문장이다. " * k for k in range(1, 9)),
        "👩‍👩‍👧é" * 700,
        "한" * 3000 + "\r" + "a1-" * 500,
    ]
    for text in texts:
        for overlap in (0, 50):
            got = pieces(spark, text, 400, overlap)
            assert all(len(p) <= 400 for p, _ in got)
            assert "".join(p[s:] for p, s in got) == text
            done = ""
            for p, s in got:
                assert s == (min(overlap, len(done)) if done else 0) and done.endswith(p[:s])
                done += p[s:]


def test_cuts_at_boundaries(spark):
    text = "\n".join("A sentence of the text. " * 6 for _ in range(12))
    got = pieces(spark, text, 500, 0)
    assert all(p.endswith("\n") for p, _ in got[:-1])
    text = "This is a sentence. " * 100
    assert all(p.endswith(". ") for p, _ in pieces(spark, text, 130, 0)[:-1])


def test_tokens_edges_and_empty(spark):
    assert pieces(spark, "", 10, 2) == [("", 0)]
    assert pieces(spark, None, 10, 2) == []
    assert pieces(spark, "short", 10, 2) == [("short", 0)]
    got = pieces(spark, "가" * 1100, 1200, 100, 900)
    assert len(got) > 1 and all(len(p) <= 900 for p, _ in got)
    assert len(pieces(spark, "abc " * 290, 1200, 100, 900)) == 1
