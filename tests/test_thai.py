import random
import unicodedata

from pyspark.sql import functions as F

from citeframe.functions import thai


def _one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_dates(spark):
    f = lambda t: _one(spark, thai.be_date_to_ce, t)
    assert f("2569-03-15") == "2026-03-15"
    assert f("15 มีนาคม 2569") == "15 มีนาคม 2026"
    assert f("12569 2570") == "12026 2570"
    assert f("25๖๙-01") == "2026-01"
    assert f("1999") is None and f("") is None and f(None) is None


def test_normalize(spark):
    from citeframe.shipping import ship

    ship(spark)
    rows = ["é ๑๒", "plain", "กำ", "", None]
    got = [r.y for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").select("k", thai.normalize(F.col("t")).alias("y")).orderBy("k").collect()]
    assert got == [None if t is None else unicodedata.normalize("NFC", t).translate(str.maketrans(thai.THAI_DIGITS, "0123456789")) for t in rows]


def test_number_words_round_trip(spark):
    rnd = random.Random(5)
    ns = [*range(1, 400), *[rnd.randrange(1, 10**12) for _ in range(400)]]
    rows = spark.createDataFrame([(n,) for n in ns], "n bigint").select("n", thai.number_words(thai.words_of(F.col("n"))).alias("m")).collect()
    assert all(r.n == r.m for r in rows)


def test_number_words_odd(spark):
    f = lambda t: _one(spark, thai.number_words, t)
    assert f("ยี่สิบเอ็ดบาทถ้วน") == 21
    assert f("หนึ่งล้าน สองแสน") == 1_200_000
    assert f("ไม่มี") is None and f("") is None and f(None) is None
    assert _one(spark, thai.number_words_strict, "สามารถ") is None


def test_anomalies(spark):
    f = lambda t: _one(spark, thai.glyph_anomalies, t)
    assert f("กลุ่ม") == [] and f("่ก") == [] and f("") == []
    got = f("น ่าทิ้ง")
    assert [(g.pos, g.context) for g in got] == [(2, "น ่าทิ้ง")]
    assert "U+0E48" in got[0].reason


def test_rounding(spark):
    from citeframe.shipping import ship

    ship(spark)
    row = spark.range(1).select(thai.py_round(F.lit(2.675), 2).alias("a"), thai.py_round(F.lit(8.33335), 4).alias("b")).first()
    assert (row.a, row.b) == (round(2.675, 2), round(8.33335, 4))
