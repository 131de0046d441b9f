from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.operators import chunking, layout

LINES = "doc_id string, page_index int, block_order int, col_index int, text string, size double, fontname string, x0 double, x1 double, top double, bottom double, n_chars int"


def lines(spark, rows, doc="d"):
    full = [(doc, r[0], r[1], 0, r[2], r[3] if len(r) > 3 else 10.0, r[4] if len(r) > 4 else "HCRBatang", 20.0, 200.0, 100.0, 110.0, len(r[2] or "")) for r in rows]
    return spark.createDataFrame(full, LINES)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_scalars(spark):
    t = F.lit
    assert one(spark, X.token_count(t("메모리 카드를"))) == 6
    assert [one(spark, X.undouble(t(a), d)) for a, d in (("제제11조조", True), ("제제1100조조", True), ("11000000톤", True), ("제제11조조", False), ("1000톤", False))] == ["제1조", "제10조", "1000톤", "제11조", "1000톤"]
    fonts = ["SDGothic-cBd", "XYZABC+HCRBatang-Bold", "NimbusRomNo9L-Medi", "SDMyeongjo-aLt", "NimbusRomNo9L-Regu", "Foo-Semibold", "HCRBatang", "H2mjsM", "F9", "ArialMT"]
    assert [one(spark, layout.font_weight(t(f))) for f in fonts] == [5, 5, 3, 1, 2, 4, None, None, None, None]
    assert [one(spark, X.script_of(t(x))) for x in ("연차 휴가", "leave", "RAG是什么技术？", "12")] == ["han", "latin", "cjk", "other"]
    assert one(spark, X.gram_overlap(t("연차휴가"), t("연차휴가 일수"))) == 1.0 and one(spark, X.gram_overlap(t("연차휴가"), t("해고 예고"))) == 0.0 and one(spark, X.gram_overlap(t(""), t("abc"))) == 0.0
    assert one(spark, X.slugify(t("Work Rules (2026)!"))) == "work-rules-2026" and one(spark, X.slugify(t("★"))) is None
    assert one(spark, X.estimated_tokens(t(160))) == 100
    assert [one(spark, X.language_matches(t(a), t(b))) for a, b in (("휴가는 매년 부여한다", "ko"), ("휴가는 매년 부여한다", "en"), ("leave is granted", "en"), ("휴가는 年 부여", "ko"))] == [True, False, True, False]


def test_citations(spark):
    t = F.lit
    assert one(spark, X.keep_known(t("a [cite:1] b [cite:9]"), 2)) == "a [cite:1] b "
    assert one(spark, X.keep_known(t("x [cite:2,99]"), 2)) == "x [cite:2]" and one(spark, X.keep_known(t("[cite: 1 , 2 ]"), 2)) == "[cite:1,2]"
    assert one(spark, X.normalize_citations(t("a [1, 2] b[c]"))) == "a [cite:1, 2] b[c]"
    assert one(spark, X.claims_cited(t("One. [cite:1] Two.[cite:2]"))) and not one(spark, X.claims_cited(t("One.[cite:1] Two.")))
    assert not one(spark, X.claims_cited(t("")))


def test_running_heads_and_headings(spark):
    rows = [(p, 0, "레코딩") for p in range(1, 6)] + [(p, 1, f"본문 {p}") for p in range(1, 6)] + [(1, 2, "같은 쪽"), (1, 3, "같은 쪽"), (1, 4, "같은 쪽"), (2, 2, None), (2, 3, "")]
    df = lines(spark, rows)
    dropped = {(r["page_index"], r["block_order"]) for r in layout.repeated_lines(df).collect()}
    assert dropped == {(p, 0) for p in range(2, 6)}
    body = [(1, i, "x" * 28, 8.0) for i in range(6)] + [(1, 6 + i, "y" * 28, 8.5) for i in range(5)] + [(1, 20, "제목", 12.0)]
    df = lines(spark, body)
    sizes = layout.body_sizes(df)
    assert tuple(sizes.first())[1:] == (8.0, 8.5)
    heads = layout.headings_by_font(layout.heading_candidates(df, layout.repeated_lines(df)), sizes)
    assert [r["text"] for r in heads.collect()] == ["제목"]
    levels = layout.heading_levels(lines(spark, [(1, 0, "a", 20.0), (1, 1, "b", 14.0), (1, 2, "c", 12.0)]))
    assert {r["text"]: r["level"] for r in levels.collect()} == {"a": 1, "b": 2, "c": 3}
    assert layout.repeated_lines(df.limit(0)).count() == 0


def test_numbering(spark):
    rows = [(1 + i // 3, i, f"제{i}조(목적)") for i in range(1, 13)] + [(1, 90, "제5조에 따라")]
    got = {r["pattern"]: r for r in layout.numbering_sequences(lines(spark, rows)).collect()}
    assert set(got) == {"제N조"}
    s = got["제N조"]
    assert (s["observed"], s["missing"], s["longest_run"], s["usable"]) == (12, [], 12, True)
    rows = [(1, i, f"{n}. x") for i, n in enumerate([1, 2, 2, 3, 3, 4])]
    assert layout.numbering_sequences(lines(spark, rows)).first()["longest_run"] == 4
    rows = [(1, i, f"{n}. x") for i, n in enumerate([1, 2, 3, 1, 2, 3])]
    assert layout.numbering_sequences(lines(spark, rows)).first()["longest_run"] == 3


def test_columns(spark):
    def mode(counts):
        rows = [("d", i, c) for i, c in enumerate(c for c, n in counts.items() for _ in range(n))]
        return layout.stable_columns(spark.createDataFrame(rows, "doc_id string, page_index int, columns int")).first()["columns"]

    assert [mode(c) for c in ({1: 2, 2: 8, 3: 2}, {1: 9, 4: 2, 8: 1}, {2: 4, 3: 4, 4: 4})] == [2, 1, 1]
    two = [("d", 1, i, 0, "t", 10.0, "f", x0, x1, 0.0, 0.0, 1) for i, (x0, x1) in enumerate([(20, 170), (200, 350)] * 5)]
    df = spark.createDataFrame([(*r[:7], float(r[7]), float(r[8]), *r[9:]) for r in two], LINES)
    gaps = layout.gutters(df, 362.0, 160).collect()
    assert len(gaps) == 1 and 165 < gaps[0]["lo"] < gaps[0]["hi"] <= 200
    assert layout.gutters(df, 362.0, 8).count() == 0


def test_line_building(spark):
    rows = [("앞", 10.0, 15.0), ("뒤", 70.0, 75.0), ("글", 75.0, 80.0)]
    df = spark.createDataFrame([("d", 1, i, 0, t, 10.0, "ABCDEF+Batang" if i else "Gulim", a, b, 100.0 + i % 2, 110.0 + i % 2, 1) for i, (t, a, b) in enumerate(rows)], LINES)
    none = layout.gutters(df.limit(0))
    r = layout.build_lines(df, none).first()
    assert (r["text"], r["n_chars"], r["size"], r["fontname"], r["pieces"]) == ("앞 뒤글", 3, 10.0, "Batang", 3)
    gap = spark.createDataFrame([("d", 1, 30.0, 50.0)], "doc_id string, page_index int, lo double, hi double")
    assert {(r["column"], r["text"]) for r in layout.build_lines(df, gap).collect()} == {(0, "앞"), (1, "뒤글")}
    wide = df.unionAll(spark.createDataFrame([("d", 1, 9, 0, "x", 10.0, None, 20.0, 60.0, 200.0, 210.0, 1), ("d", 1, 10, 0, None, None, None, None, None, None, None, None), ("d", 1, 11, 0, "  ", 9.0, "f", 1.0, 2.0, 300.0, 310.0, 0)], LINES))
    assert [r["block_order"] for r in layout.with_columns(wide, gap).where("crosses").collect()] == [9]
    assert layout.build_lines(wide, gap).count() == 3 and layout.build_lines(df.limit(0), gap).count() == 0
    order = [r["block_order"] for r in layout.reading_order(df).orderBy("place").collect()]
    assert order == [0, 1, 2]
    assert {r["block_order"] for r in layout.in_band(wide, 0.4, 0.9).collect()} == {9}


def test_section_tree_and_chunks(spark):
    heads = spark.createDataFrame([("d", 1, 0, "제1장 총칙", 1), ("d", 1, 1, "제1조 목적", 2), ("d", 2, 0, "제2장 채용", 1), ("e", 1, 0, "깊다", 9), ("e", 1, 1, "얕다", 1)], "doc_id string, page_index int, block_order int, title string, level int")
    tree = {(r["doc_id"], r["seq"]): (r["path"], r["depth"], r["parent_seq"]) for r in chunking.section_heads(heads).collect()}
    assert tree[("d", 0)] == ("제1장 총칙", 0, None) and tree[("d", 1)] == ("제1장 총칙 > 제1조 목적", 1, 0) and tree[("d", 2)] == ("제2장 채용", 0, None)
    assert tree[("e", 0)][1] == 0 and tree[("e", 1)] == ("얕다", 0, None)
    body = lines(spark, [(1, 0, "제1장 총칙"), (1, 1, "제1조 목적"), (1, 2, "본문"), (2, 0, "제2장 채용"), (2, 1, "끝"), (3, 0, "꼬리")])
    s = chunking.sections(body, chunking.section_heads(heads.where("doc_id = 'd'")))
    got = {r["seq"]: r for r in s.collect()}
    assert (got[1]["body"], got[2]["body"], got[2]["end_page"], got[1]["parent_id"]) == ("본문", "끝\n꼬리", 3, "d#s0000")
    made = chunking.chunk_sections(s, least=100).collect()
    assert len(made) == 1 and made[0]["section_ids"] == ["d#s0000", "d#s0001", "d#s0002"] and made[0]["title"] == "제1장 총칙"
    assert chunking.chunk_sections(s.limit(0)).count() == 0


def test_split_body_and_fixed(spark):
    body = "\n".join("z" * 90 for _ in range(30))
    got = one(spark, chunking.split_body(F.col("b"), 500), b=body)
    assert len(got) > 1 and all(len(p) <= 500 for p in got) and "\n".join(got) == body
    assert one(spark, chunking.split_body(F.col("b"), 500), b="short") == ["short"]
    rows = [(1 + i // 10, i, "w" * 90) for i in range(30)]
    made = chunking.chunk_fixed(lines(spark, rows).unionAll(lines(spark, rows[:3], "e")), 500).collect()
    assert sum(len(r["body"].split("\n")) for r in made) == 33 and all(len(r["body"]) <= 500 for r in made)
    assert chunking.chunk_fixed(lines(spark, rows).limit(0)).count() == 0


def test_fixed_chunks_equal_a_plain_walk(spark):
    import random

    rng = random.Random(3)
    docs = {"big": [rng.choice(["", "  ", "x" * rng.randint(1, 30)]) for _ in range(400)], "blank": ["", " "], "one": ["y" * 99]}
    df = spark.createDataFrame([("d", 1, 0, 0, "t", 1.0, "f", 0.0, 1.0, 0.0, 1.0, 1)], LINES).limit(0)
    rows = [(d, 1 + i // 7, i % 7, 0, t, 1.0, "f", 0.0, 1.0, 0.0, 1.0, 1) for d, ls in docs.items() for i, t in enumerate(ls)]
    df = df.unionAll(spark.createDataFrame(rows, LINES))
    want = []
    for d, ls in docs.items():
        held, size, made = [], 0, []
        for t in ls:
            if held and size + len(t) + 1 > 20:
                made.append("\n".join(held))
                held, size = [], 0
            held.append(t)
            size += len(t) + 1
        made.append("\n".join(held))
        want += [(d, i, body) for i, body in enumerate(b for b in made if b.strip())]
    got = [(r["doc_id"], r["seq"], r["body"]) for r in chunking.chunk_fixed(df, 20, 32).collect()]
    assert sorted(got) == sorted(want)
    assert chunking.chunk_fixed(df.limit(0)).count() == 0
