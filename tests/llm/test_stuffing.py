import random

from docmill.llm import stuffing

LATIN = "valves pumping hosing gasket flange piston rotors nozzle sealed bushes washer screws bolted copper rubber".split()
HANGUL = "밸브 펌프 호스 가스켓 플랜지 피스톤 로터 노즐 씰링 부싱 와셔 나사 볼트 구리 고무".split()


def test_lists_longer_than_the_windows_are_stuffed(spark):
    rng = random.Random(1)
    mixed = [w for _ in range(50) for w in rng.sample(LATIN, len(LATIN))]
    once = [f"{a}{b}" for a in LATIN for b in ("", "like", "wise")]
    texts = [" ".join(LATIN * 50), " ".join(HANGUL * 50), "".join(HANGUL * 50), " ".join(mixed), " ".join(once)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["share"] for r in stuffing.stuffed_share(df, "doc_id", "text").collect()}
    assert all(got[i] > 0.9 for i in range(4)) and got[4] == 0
