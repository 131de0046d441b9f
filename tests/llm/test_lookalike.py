from docmill.llm import lookalike as L


def test_equal_looks_have_one_form_and_differences_stay():
    lat = L.Lattice({"va": 5, "al": 9, "lv": 4, "ve": 6})
    same = [
        ("ｖａｌｖｅ　ＡＢ", "valve AB"), ("va​lve AB", "valve  AB"), ("vаlvе", "valve"), ("café", "café"),
        ("한", "한"), ("ﬂow", "flow"), ("XM‐1", "XM-1"), ("Part Ⅳ", "Part IV"), ("5µ", "5μ"), ("a\r\nb", "a \nb"), ("ё", "ë"),
    ]
    for a, b in same:
        assert lat.form(a) == lat.form(b), (a, b)
    for a, b in [("m2", "m²"), ("H2O", "H₂O"), ("1", "①"), ("cafe", "café"), ("Valve", "valve"), ("½", "1/2"), ("ab", "a b"), ("a\nb", "a b"), ("\U0001f469‍\U0001f467", "\U0001f469\U0001f467")]:
        assert lat.form(a) != lat.form(b), (a, b)


def test_scripts_stay_consistent():
    lat = L.Lattice({"со": 50, "ор": 40, "жо": 9, "co": 3, "op": 2})
    assert lat.form("жор") == "жор"
    assert lat.form("сор") == lat.form("cop") == "сор"


def test_pairs_and_edges(spark):
    df = spark.createDataFrame(
        [("d", "1", "Type A-1", 1), ("d", "2", "Type A‐1", 2), ("d", "3", "Type A-1", 3), ("e", "4", "Type A-1", 4), ("d", "5", None, 5), ("d", "6", "", 6), ("d", "7", "​", 7)],
        "scope string, key string, text string, look int",
    )
    formed = L.add_form(df, "text", L.pair_counts(df, "text"))
    assert {tuple(r) for r in L.same_look(formed, "scope", "key", "text").collect()} == {("1", "2"), ("2", "3")}
    assert L.same_look(formed.limit(0), "scope", "key", "text").count() == 0
    assert L.add_form(df.select("text"), "text", {}).where("text is null").first()["form"] is None


def test_the_path_decides_by_letters_around(spark):
    """All letters of these tokens have look-alikes or stand in both corpora: what is written follows from the counted pairs alone."""
    latin = spark.createDataFrame([("score scope copper sport",)] * 3, "text string")
    cyrillic = spark.createDataFrame([("сорок просо спорт",)] * 3, "text string")
    a, b = (L.Lattice(L.pair_counts(x, "text")) for x in (latin, cyrillic))
    assert a.form("сор") == a.form("cop") == "cop" and b.form("сор") == b.form("cop") == "сор"
    # a letter without look-alikes is evidence: Cyrillic л before, Latin r after
    both = L.Lattice(L.pair_counts(latin.unionAll(cyrillic).unionAll(spark.createDataFrame([("лось", ), ("core",)], "text string")), "text"))
    assert both.form("лoc") == "лос" and both.form("сorr") == "corr"


def test_looks_give_one_row_a_row(spark):
    rows = [("d", str(i), t) for i, t in enumerate(["A-1", "A‐1", "A-1", "B", None])]
    df = spark.createDataFrame(rows, "scope string, key string, text string")
    got = L.looks(L.add_form(df, "text", {}), "scope", "key", "text").collect()
    assert len(got) == 4 and len({r["look"] for r in got}) == 2
