"""The engine from SQL: a table function and scalar functions, registered in a session.

    select * from cite_blocks(table(select doc_id, text from documents) partition by doc_id)
    select cite_locator(kind, page, ref), cite_verdict(expected, actual) from facts

The scalar functions are SQL themselves, so that they are planned with the query they stand in.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from citeframe.functions.text import WHITE
from citeframe.shipping import ship

#: name, parameters, type and body of each scalar function; what they give is what the functions of citeframe.functions.text give
FUNCTIONS = (
    ("cite_squeeze", "t string", "string", "trim(regexp_replace(t, r'(?U)\\s+', ' '))"),
    ("cite_bigrams", "t string", "array<string>", "case when length(t) = 1 then array(t) else array_distinct(regexp_extract_all(t, r'(?s)(?=(..)).', 1)) end"),
    ("cite_similarity", "a string, b string", "double", """case when cite_squeeze(coalesce(a, '')) = '' or cite_squeeze(coalesce(b, '')) = '' then 0.0D
        when contains(cite_squeeze(a), cite_squeeze(b)) or contains(cite_squeeze(b), cite_squeeze(a)) then 1.0D
        else size(array_intersect(cite_bigrams(cite_squeeze(a)), cite_bigrams(cite_squeeze(b)))) / cast(size(array_union(cite_bigrams(cite_squeeze(a)), cite_bigrams(cite_squeeze(b)))) as double) end"""),
    ("cite_verdict", "expected string, actual string", "string", """case when expected is null and actual is null then 'exact' when expected is null then 'hallucinated' when actual is null then 'missed'
        when cite_squeeze(expected) = cite_squeeze(actual) or (cite_squeeze(expected) <> '' and contains(cite_squeeze(actual), cite_squeeze(expected)))
            or (cite_squeeze(actual) <> '' and contains(cite_squeeze(expected), cite_squeeze(actual))) then 'exact' else 'wrong' end"""),
    ("cite_locator", "kind string, page int, ref string", "string", """coalesce(case when kind = 'text_page' then concat('หน้า ', page) when kind = 'vision_page' then concat('หน้า ', page, ' (อ่านจากภาพสแกน)')
        when kind = 'paragraph' then concat('ย่อหน้าที่ ', regexp_extract(ref, r'(?s)^[^:]*:(.*)$', 1))
        when kind = 'table_cell_docx' then concat('ตารางที่ ', substring(get(split(ref, ':'), 0), 2), ' แถว ', substring(get(split(ref, ':'), 1), 2), ' คอลัมน์ ', substring(get(split(ref, ':'), 2), 2)) when kind is not null then ref end, '')"""),
    ("cite_sheet", "ref string", "string", "case when contains(ref, '!') then regexp_extract(ref, r'(?s)^(.*)!([^!]*)$', 1) end"),
    ("cite_cell", "ref string", "string", "case when contains(ref, '!') then regexp_extract(ref, r'(?s)^(.*)!([^!]*)$', 2) end"),
)


class CiteBlocks:
    """The non-blank lines of each row of a table with a column `text`, numbered from 1, with the table's other columns before them."""

    def __init__(self, analyzed: AnalyzeResult) -> None:
        self.kept = [f.name for f in analyzed.schema.fields[:-4]]

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("cite_blocks takes a table")
        names = [f.name for f in rows.dataType.fields]
        if "text" not in names:
            raise ValueError("cite_blocks: the table has no column text")
        made = [StructField("seq", IntegerType()), StructField("kind", StringType()), StructField("ref", StringType()), StructField("block", StringType())]
        clash = sorted({n.lower() for n in names} & {f.name for f in made})
        if clash:
            raise ValueError(f"cite_blocks: names of results: {', '.join(clash)}")
        return AnalyzeResult(StructType([*[f for f in rows.dataType.fields if f.name != "text"], *made]))

    def eval(self, rows: Row) -> Iterator[tuple]:
        kept = [rows[n] for n in self.kept]
        seq = 0
        for line in (rows["text"] or "").split("\n"):
            line = line.strip(WHITE)
            if line:
                seq += 1
                yield (*kept, seq, "paragraph", f"para:{seq}", line)


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, for as long as it lasts; those of the same names are replaced."""
    ship(spark)
    spark.udtf.register("cite_blocks", udtf(CiteBlocks))
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
