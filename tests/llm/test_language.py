import random

from pyspark.sql import functions as F

from docmill.llm import language as L

KO = ["연차 휴가는 매년 정기적으로 사용하여야 한다", "설비의 점검은 담당자가 매월 실시한다", "요금은 다음 달에 정산하는 것을 원칙으로 한다", "안전 교육을 받지 아니한 사람은 출입할 수 없다"]
EN = ["the pump is checked by the owner every month", "staff may not enter the plant without a permit", "the fee is paid on the first day of each month", "all drawings shall be kept with the manual"]
DE = ["die pumpe wird jeden monat vom betreiber geprüft", "ohne genehmigung darf die anlage nicht betreten werden", "die gebühr wird am ersten tag jedes monats bezahlt", "alle zeichnungen sind mit dem handbuch aufzubewahren"]


def sentence(lines, rng):
    """Words of a language in a new order."""
    words = " ".join(lines).split()
    return " ".join(rng.choice(words) for _ in range(9))


def rows(spark):
    data, rng = [], random.Random(4)
    for n in range(30):
        for lang, text in (("ko", KO), ("en", EN), ("de", DE)):
            label = lang if n % 6 else "en"  # a sixth are wrong
            data.append((f"{lang}{n}", "\n".join(sentence(text, rng) for _ in range(3)), label))
    return spark.createDataFrame(data, "key string, text string, label string")


def test_wrong_labels_are_seen_through(spark):
    df = rows(spark)
    model = L.train(df, "key", "text", "label")
    got = L.detect(df, ["key"], "text", model).collect()
    assert sum(r["lang"] == r["key"][:2] for r in got) >= 0.97 * len(got)


def test_segments_and_edges(spark):
    model = L.train(rows(spark), "key", "text", "label")
    found = L.judge_texts(model, ["\n".join([KO[0], EN[1], KO[2], "KP-41 | 75 |", ""]), "", None, "12 - 30.5", KO[0] * 3000])
    assert found[0][0] == "ko" and [(n, k) for n, k, _ in found[0][2]] == [(2, "en")]
    assert [f[0] for f in found[1:4]] == [None, None, None] and found[4][0] == "ko"
    empty = L.train(rows(spark).limit(0), "key", "text", "label")
    assert L.judge_texts(empty, [KO[0]])[0][0] is None


def test_labels_and_cards(spark):
    names = ["ko", " KO ", "ko-KR", "kor", "ger", "mixed", "", "und", "??", None, "n/a", "English", "zh_CN"]
    df = spark.createDataFrame([(n,) for n in names], "label string")
    got = [r[0] for r in df.select(L.clean_label(F.col("label"))).collect()]
    assert got == ["ko", "ko", "ko", "ko", "de", "mixed", None, None, None, None, None, None, "zh"]
    counts = spark.createDataFrame([("a", "ko", 9), ("a", "en", 1), ("b", "ko", 5), ("b", "en", 5)], "doc string, lang string, n long")
    assert {(r["doc"], r["lang"]) for r in L.mixed_or_top(counts, "doc").collect()} == {("a", "ko"), ("b", "mixed")}
