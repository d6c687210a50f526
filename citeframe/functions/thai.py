"""Thai text as Column functions: digits, Buddhist-Era dates, number words, combining-mark anomalies."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from citeframe.functions.numbers import half_even as py_round  # noqa: F401

# Words and characters of the Thai language.
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
DIGIT_WORDS = {"ศูนย์": 0, "หนึ่ง": 1, "เอ็ด": 1, "สอง": 2, "ยี่": 2, "สาม": 3, "สี่": 4, "ห้า": 5, "หก": 6, "เจ็ด": 7, "แปด": 8, "เก้า": 9}
UNIT_WORDS = {"สิบ": 10, "ร้อย": 100, "พัน": 1_000, "หมื่น": 10_000, "แสน": 100_000, "ล้าน": 1_000_000}
NOISE_WORDS = ("บาทถ้วน", "บาทพอดี", "บาท", "ถ้วน", "พอดี")
COMBINING = "ัิ-ฺ็-๎"
CONSONANTS = "ก-ฮ"

NUMBER_WORDS = DIGIT_WORDS | UNIT_WORDS
#: Buddhist-Era years run ahead of the Common Era by so much.
ERA = 543


@F.pandas_udf(StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """NFC.  Text all below U+0300 is NFC by definition: it is passed as null, so that the UDF does nothing for it."""
    plain = ~text.rlike("[^\\x{0000}-\\x{02ff}]")
    return F.when(plain, text).otherwise(_nfc(F.when(~plain, text)))


def arabic_digits(text: Column) -> Column:
    return F.translate(text, THAI_DIGITS, "0123456789")


def normalize(text: Column) -> Column:
    return arabic_digits(nfc(text))


def be_to_ce(year: Column) -> Column:
    return year - ERA


def be_date_to_ce(text: Column) -> Column:
    """The first run of a year 24xx, 25xx or 26xx, wherever it stands, made Common Era; null if there is none."""
    pattern = r"(?s)(?U)^(.*?)((?:24|25|26)\d{2})(.*)$"
    year = arabic_digits(F.regexp_extract(text, pattern, 2))
    new = F.concat(F.regexp_extract(text, pattern, 1), be_to_ce(year.try_cast("int")).cast("string"), F.regexp_extract(text, pattern, 3))
    return F.when(year != "", new)


def glyph_anomalies(text: Column, context: int = 20) -> Column:
    """(pos, context, reason) where a run of combining marks starts without a consonant before it; a mark at the very start isn't told."""
    at = F.filter(
        F.sequence(F.lit(2), F.greatest(F.length(text), F.lit(2))),
        lambda i: text.substr(i, F.lit(1)).rlike(f"^[{COMBINING}]$") & ~text.substr(i - 1, F.lit(1)).rlike(f"^[{CONSONANTS}{COMBINING}]$"),
    )
    def told(i: Column) -> Column:
        mark = text.substr(i, F.lit(1))
        start = F.greatest(F.lit(1), i - context)
        code = F.lpad(F.hex(F.conv(F.hex(F.encode(mark, "UTF-16BE")), 16, 10).cast("bigint")), 4, "0")
        reason = F.concat(F.lit("combining-mark run starting with '"), mark, F.lit("' (U+"), code, F.lit(") has no preceding Thai consonant"))
        return F.struct((i - 1).alias("pos"), text.substr(start, i + context - start).alias("context"), reason.alias("reason"))
    return F.transform(at, told)


def glyph_anomaly_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"(?<=[^{CONSONANTS}{COMBINING}])[{COMBINING}]"), F.lit(0)))


def number_tokens(text: Column) -> Column:
    """The number words of the first run; white space between them is allowed."""
    words = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
    for noise in NOISE_WORDS:
        text = F.replace(text, F.lit(noise), F.lit(" "))
    run = F.regexp_extract(text, rf"(?U)((?:{words})(?:\s*(?:{words}))*)", 1)
    return F.regexp_extract_all(run, F.lit(words), F.lit(0))


def number_words(text: Column) -> Column:
    """The first run of number words as an integer, or null.

    Kept as they are: words inside other words count, a digit before a digit is overwritten, and a second million
    word adds another million instead of multiplying.
    """
    value = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, n)])
    big = F.lit(0).cast("bigint")
    none = F.lit(None).cast("bigint")
    tokens = F.transform(number_tokens(text), lambda w: F.element_at(value, w).cast("bigint"))
    make = lambda t, s, d: F.struct(t.cast("bigint").alias("t"), s.cast("bigint").alias("s"), d.cast("bigint").alias("d"))
    def step(a: Column, v: Column) -> Column:
        filled = a["s"] + F.coalesce(a["d"], big)
        million = a["t"] + F.when(filled == 0, 1).otherwise(filled) * 1_000_000
        return F.when(v < 10, make(a["t"], a["s"], v)).when(v < 1_000_000, make(a["t"], a["s"] + F.coalesce(a["d"], F.lit(1).cast("bigint")) * v, none)).otherwise(make(million, big, none))
    return F.when(F.size(tokens) > 0, F.aggregate(tokens, make(big, big, none), step, lambda a: a["t"] + a["s"] + F.coalesce(a["d"], big)))


def number_words_strict(text: Column) -> Column:
    """As number_words, but only where the run isn't part of a longer Thai word; for checks that must not raise false alarms."""
    words = "|".join(sorted([*NUMBER_WORDS, *NOISE_WORDS], key=len, reverse=True))
    return F.when(text.rlike(rf"(?U)(?:^|[^\x{{0e00}}-\x{{0e7f}}])(?:{words})(?:\s*(?:{words}))*(?:$|[^\x{{0e00}}-\x{{0e7f}}])"), number_words(text))


def words_of(n: Column) -> Column:
    """A positive integer below 10**12 in number words (the inverse of number_words), by groups of six digits."""
    digits = list(DIGIT_WORDS)
    names = ["ศูนย์", "หนึ่ง", "สอง", "สาม", "สี่", "ห้า", "หก", "เจ็ด", "แปด", "เก้า"]
    assert all(x in digits for x in names)
    def group(v: Column) -> Column:
        out = F.lit("")
        for size, unit in ((100_000, "แสน"), (10_000, "หมื่น"), (1_000, "พัน"), (100, "ร้อย"), (10, "สิบ"), (1, "")):
            d = F.floor(v / size) % 10
            out = F.concat(out, F.when(d == 0, F.lit("")).otherwise(F.concat(F.element_at(F.array(*[F.lit(x) for x in names]), (d + 1).cast("int")), F.lit(unit))))
        return out
    high = F.floor(n / 1_000_000)
    return F.concat(F.when(high > 0, F.concat(group(high), F.lit("ล้าน"))).otherwise(""), group(n % 1_000_000))
