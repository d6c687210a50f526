"""Locators, cell texts, scoring text and small parsers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeframe.functions.numbers import half_even
from citeframe.functions.thai import nfc

#: Formats of a source's ref by kind; pages have none.
REF_FORMATS = {"paragraph": r"(?U)^para:\d+$", "table_cell_docx": r"(?U)^t\d+:r\d+:c\d+$", "cell_xlsx": r"(?U)^.+![A-Z]+\d+$"}
PAGE_KINDS = ("text_page", "vision_page")
MATCH_THRESHOLD = 0.3
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u2003\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters, found in one pass; a single character counts as its own pair."""
    pairs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(..))."), F.lit(1)))
    return F.when(F.length(text) == 1, F.array(text)).otherwise(pairs)


def prepared(texts: Column) -> Column:
    """array<struct<t, g>>: each text squeezed (null: empty), with its bigrams, so that comparing many pairs prepares each text once."""
    squeezed = F.transform(texts, lambda x: squeeze(F.coalesce(x, F.lit(""))))
    return F.transform(squeezed, lambda t: F.struct(t.alias("t"), bigrams(t).alias("g")))


def prepared_similarity(a: Column, b: Column) -> Column:
    """0 if either is empty, 1 if one holds the other, else the Jaccard similarity of their bigrams."""
    x, y = a["t"], b["t"]
    # the number of common bigrams is needed twice, so it is bound once
    common = F.transform(F.array(F.size(F.array_intersect(a["g"], b["g"]))), lambda n: n / (F.size(a["g"]) + F.size(b["g"]) - n).cast("double"))
    return F.when((x == "") | (y == ""), 0.0).when(x.contains(y) | y.contains(x), 1.0).otherwise(F.element_at(common, 1))


def similarity(a: Column, b: Column) -> Column:
    """The similarity of two texts; see prepared_similarity."""
    both = F.array(prepared(F.array(a, b)))
    return F.element_at(F.transform(both, lambda p: prepared_similarity(p[0], p[1])), 1)


def verdict(expected: Column, actual: Column, text: bool = True) -> Column:
    """exact, wrong, missed or hallucinated; texts also agree if one, not empty, holds the other.  Doubles count rounded to cents."""
    both = (squeeze(expected), squeeze(actual)) if text else (expected, actual)
    e, a = both
    same = (e == a) | ((e != "") & a.contains(e)) | ((a != "") & e.contains(a)) if text else e == a
    return F.when(expected.isNull() & actual.isNull(), "exact").when(expected.isNull(), "hallucinated").when(actual.isNull(), "missed").when(same, "exact").otherwise("wrong")


def number_verdict(expected: Column, actual: Column) -> Column:
    rounded = F.transform(F.array(expected, actual), lambda x: half_even(x, 2))
    return F.get(F.transform(F.array(rounded), lambda r: verdict(r[0], r[1], text=False)), F.lit(0))


def primary_text(*fields: Column, rest: list[Column]) -> Column:
    """The first non-empty of the fields, else the given scalars joined by spaces."""
    return F.coalesce(*[F.nullif(f.cast("string"), F.lit("")) for f in fields], F.concat_ws(" ", *[r.cast("string") for r in rest]))


# The words of a citation's place.
def locator(kind: Column, page: Column, ref: Column, viewer: bool = False) -> Column:
    """A citation's place in words; the viewer has another remark for pages read from images."""
    cell = F.split(ref, ":")
    part = lambda k: F.substring(F.element_at(cell, k), 2, 100)
    scanned = " (ภาพสแกน)" if viewer else " (อ่านจากภาพสแกน)"
    return F.coalesce(
        F.when(kind == "text_page", F.concat(F.lit("หน้า "), page.cast("string")))
        .when(kind == "vision_page", F.concat(F.lit("หน้า "), page.cast("string"), F.lit(scanned)))
        .when(kind == "paragraph", F.concat(F.lit("ย่อหน้าที่ "), F.regexp_extract(ref, r"(?s)^[^:]*:(.*)$", 1)))
        .when(kind == "table_cell_docx", F.concat(F.lit("ตารางที่ "), part(1), F.lit(" แถว "), part(2), F.lit(" คอลัมน์ "), part(3)))
        .when(kind.isNotNull() & (F.lit(not viewer) | (kind == "cell_xlsx")), ref),
        F.lit(""),
    )


def cell_sheet(ref: Column) -> Column:
    """The part before the last ! of a cell reference; null if there is none."""
    return F.when(ref.contains("!"), F.regexp_extract(ref, r"(?s)^(.*)!([^!]*)$", 1))


def cell_ref(ref: Column) -> Column:
    return F.when(ref.contains("!"), F.regexp_extract(ref, r"(?s)^(.*)!([^!]*)$", 2))


def is_page(kind: Column) -> Column:
    return F.coalesce(kind.isin(*PAGE_KINDS), F.lit(False))


def is_vision(kind: Column) -> Column:
    return F.coalesce(kind == "vision_page", F.lit(False))


def number_text(x: Column) -> Column:
    """A spreadsheet's number: whole ones without a fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def bool_text(x: Column) -> Column:
    return F.when(x, "TRUE").when(~x, "FALSE")


def list_text(items: Column) -> Column:
    """A list of strings as Python prints it."""
    quoted = F.transform(items, lambda s: F.when(s.contains("'") & ~s.contains('"'), F.concat(F.lit('"'), s, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def view_number(x: Column, places: int = 3) -> Column:
    """Digits grouped by thousands, without trailing zeros."""
    return F.regexp_replace(F.format_number(x, places), r"\.?0+$", "") if places else F.format_number(x, 0)


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def strip_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(pdf|docx|xlsx)$", "")


def view_value(kind: str, value: Column) -> Column:
    """A leaf's value as shown: null is empty, lists are joined, numbers grouped."""
    shown = F.array_join(value, ", ") if kind == "arr" else view_number(value) if kind == "num" else value
    return F.coalesce(shown, F.lit(""))


def notice(status: Column) -> Column:
    """What an upload's status calls for: a refusal is told as such, any other failure as an error."""
    return F.when(status == 200, "result").when(status == 422, "refused").otherwise("error")


def split_list(text: Column) -> Column:
    """Comma-separated values, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda s: strip(s)), lambda s: s != "")


def override_part(text: Column, k: int) -> Column:
    """Provider (1) or model (2) of `provider:model`; null unless both are there."""
    return F.nullif(F.regexp_extract(text, r"(?s)^([^:]+):(.+)$", k), F.lit(""))


def highlights(quote: Column, item: Column) -> Column:
    """Whether a text item, not empty, lies in the quote; both are made NFC, white space aside."""
    plain = lambda x: squeeze(nfc(x))
    return (plain(item) != "") & plain(quote).contains(plain(item))
