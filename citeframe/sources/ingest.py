"""Documents in: files to kinds, kinds to blocks and cells.  Failures are rows of `rejects`, and then there are no blocks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from citeframe import schema
from citeframe.operators.blocks import MAX_BLOCKS, MAX_CELLS
from citeframe.operators import blocks as block_ops
from citeframe.operators import pages as page_ops
from citeframe.shipping import ship
from citeframe.sources import ooxml, pdf

BLOCKS = "doc_id string, seq int, kind string, page int, ref string, text string, error string"
CELLS = "doc_id string, sheet string, sheet_idx int, row int, col int, ref string, text string, error string"
#: Kinds behind a setting.
FLAGGED = {"xlsx": "TOR_ENABLE_XLSX"}
KINDS = ("pdf", "docx", "xlsx")
_TRUE = ("1", "true", "yes", "on")

#: What a spreadsheet's sheet without cells, or any sheet before its cells, is told as.
SHEET = "sheet"


def _pdf(content: bytes) -> Iterator[tuple[str, int | None, str | None, str]]:
    for page in pdf.pages(content):
        for *_, text, what in page.blocks:
            if what == 0 and (kept := ooxml.clean(text)):
                yield "text_page", page.number, None, kept


def _xlsx(content: bytes) -> Iterator[tuple[str, int | None, str | None, str]]:
    before = None
    for sheet, idx, _, _, ref, text in ooxml.xlsx_cells(content):
        if idx != before:
            yield SHEET, None, None, sheet
            before = idx
        if text is not None:
            yield "cell_xlsx", None, f"{sheet}!{ref}", text


#: kind -> function from bytes to (kind, page, ref, text); another reader can take one's place.
READERS: dict[str, Callable[[bytes], Iterator[tuple[str, int | None, str | None, str]]]] = {"pdf": _pdf, "docx": lambda b: ((k, None, r, t) for k, r, t in ooxml.docx_blocks(b)), "xlsx": _xlsx}
#: The most blocks or cells of a kind; a sheet's title is none.
CAPS = {"docx": MAX_BLOCKS, "xlsx": MAX_CELLS}


def register(kind: str, reader: Callable[[bytes], Iterator[tuple[str, int | None, str | None, str]]]) -> None:
    READERS[kind] = reader


def supported(settings: dict[str, str] | None = None) -> list[str]:
    """Kinds that are on, read when the plan is made."""
    env = os.environ if settings is None else settings
    return [k for k in KINDS if k not in FLAGGED or env.get(FLAGGED[k], "").strip().lower() in _TRUE]


def files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """path, content, length of files; a size limit reaches the scan."""
    df = spark.read.format("binaryFile").load(path)
    return df if max_bytes is None else df.filter(F.col("length") <= max_bytes)


@F.pandas_udf(StringType())
def _zip_kind(s: pd.Series) -> pd.Series:
    return s.map(lambda b: None if b is None else ooxml.kind_of(bytes(b)))


def sniff(content: Column) -> Column:
    """The kind by magic bytes; only zips go through Python."""
    magic = F.substring(content, 1, 4)
    zipped = magic == F.lit(b"PK\x03\x04")
    return F.when(magic == F.lit(b"%PDF"), "pdf").when(zipped, _zip_kind(F.when(zipped, content))).otherwise("unsupported")


def blocks(docs: DataFrame, kind: str = "docx", cap: int = MAX_BLOCKS) -> DataFrame:
    """Blocks of docs (doc_id, content) of one kind; a document that is too large or broken gives one row with an error."""
    ship(docs.sparkSession)
    reader = READERS.get(kind)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in BLOCKS.split(", ")]
        for frame in frames:
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                rows = []
                try:
                    if reader is None:
                        raise LookupError(f"no reader for {kind}")
                    for k, (what, page, ref, text) in enumerate(reader(bytes(content)), 1):
                        if k > cap:
                            raise OverflowError
                        rows.append((doc_id, k, what, page, ref, text, None))
                except OverflowError:
                    rows = [(doc_id, None, None, None, None, None, "too_large")]
                except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is told, not raised
                    rows = [(doc_id, None, None, None, None, None, f"broken: {e}"[:200])]
                yield pd.DataFrame(rows, columns=columns).astype({"seq": "Int32", "page": "Int32"})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, BLOCKS)


def cells(docs: DataFrame, cap: int = MAX_CELLS) -> DataFrame:
    """Cells of spreadsheets (doc_id, content); an empty sheet gives a row without ref and text."""
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in CELLS.split(", ")]
        for frame in frames:
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                rows, n = [], 0
                try:
                    for sheet, idx, r, c, ref, text in ooxml.xlsx_cells(bytes(content)):
                        n += text is not None
                        if n > cap:
                            raise OverflowError
                        rows.append((doc_id, sheet, idx, r, c, ref or None, text, None))
                except OverflowError:
                    rows = [(doc_id, None, None, None, None, None, None, "too_large")]
                except Exception as e:  # noqa: BLE001
                    rows = [(doc_id, None, None, None, None, None, None, f"broken: {e}"[:200])]
                yield pd.DataFrame(rows, columns=columns).astype({"sheet_idx": "Int32", "row": "Int32", "col": "Int32"})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, CELLS)


INGESTED = "doc_id string, document_kind string, seq int, kind string, page int, ref string, text string, status int, error string"


def dispatch(docs: DataFrame, kinds: list[str] | None = None, max_bytes: int = 50 << 20) -> DataFrame:
    """Documents (doc_id, content) of any kind as blocks, each read by the reader of its kind; content is read once.

    doc_id, document_kind, seq, kind, page, ref, text, status, error.  A document that fails has one row with the
    status and the error of the first guard that refuses it: larger than max_bytes (413), empty or null (400), of
    no known kind (415), of a kind that is off (415), too many blocks (422), unreadable (400).  All others have status 200; one
    without blocks has a single row without seq.
    """
    ship(docs.sparkSession)
    on = supported() if kinds is None else list(kinds)
    readers = dict(READERS)

    def read(doc_id, kind: str, content: bytes | None, size: int) -> list[tuple]:
        failed = lambda status, error, kind=None: [(doc_id, kind, None, None, None, None, None, status, error)]
        if size > max_bytes:
            return failed(413, "too many bytes")
        if size == 0:
            return failed(400, "empty")
        if kind == "unsupported":
            return failed(415, "unknown format")
        if kind not in on or kind not in readers:
            return failed(415, "kind is off", kind)
        rows, n, cap = [], 0, CAPS.get(kind)
        try:
            for k, (what, page, ref, text) in enumerate(readers[kind](bytes(content)), 1):
                n += what != SHEET
                if cap is not None and n > cap:
                    return failed(422, "too large", kind)
                rows.append((doc_id, kind, k, what, page, ref, text, 200, None))
        except Exception as e:  # noqa: BLE001 - whatever is wrong with a file is told, not raised
            return failed(400, f"broken: {e}"[:200], kind)
        return rows or [(doc_id, kind, None, None, None, None, None, 200, None)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in INGESTED.split(", ")]
        for frame in frames:
            for r in frame.itertuples(index=False):
                yield pd.DataFrame(read(r.doc_id, r.kind, r.content, int(r.size)), columns=columns).astype({"seq": "Int32", "page": "Int32", "status": "Int32"})

    size = F.coalesce(F.length("content"), F.lit(0))
    small = F.when(size <= max_bytes, F.col("content"))
    have = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.when(size > 0, sniff(F.col("content"))).otherwise("unsupported").alias("kind"), small.alias("content"), size.alias("size"))
    return have.mapInPandas(run, INGESTED)


def document_text(ingested: DataFrame) -> DataFrame:
    """doc_id, document_kind and document_text of dispatched blocks: page marks, `[ref] text` lines, or those under a line for each sheet."""
    good = ingested.filter((F.col("status") == 200) & F.col("seq").isNotNull())
    part = lambda kind, made: made.select("doc_id", F.lit(kind).alias("document_kind"), "document_text")
    cell = F.concat(F.lit("["), F.element_at(F.split("ref", "!"), -1), F.lit("] "), F.col("text"))
    line = F.when(F.col("kind") == SHEET, F.concat(F.lit("\n[ชีท: "), F.col("text"), F.lit("]"))).otherwise(cell)
    sheets = good.filter(F.col("document_kind") == "xlsx").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", line.alias("line"))))["line"], "\n").alias("document_text"))
    return (
        part("pdf", page_ops.marked_text(good.filter(F.col("document_kind") == "pdf")))
        .unionByName(part("docx", block_ops.addressed(good.filter(F.col("document_kind") == "docx")))).unionByName(part("xlsx", sheets))
    )


def meta(ingested: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """What is known of each dispatched document: paragraph_count of DOCX, sheet_names of XLSX, and page counts from page reports of PDF."""
    good = ingested.filter(F.col("status") == 200)
    names = F.sort_array(F.collect_list(F.when(F.col("kind") == SHEET, F.struct("seq", "text"))))
    each = good.groupBy("doc_id", "document_kind").agg(F.count_if(F.col("kind") == "paragraph").alias("paragraphs"), F.transform(names, lambda x: x["text"]).alias("names"))
    out = each.select("doc_id", "document_kind", F.when(F.col("document_kind") == "docx", F.col("paragraphs")).alias("paragraph_count"), F.when(F.col("document_kind") == "xlsx", F.col("names")).alias("sheet_names"))
    if reports is None:
        return out.withColumns({"page_count": F.lit(None).cast("bigint"), "usable_text_page_ratio": F.lit(None).cast("double"), "image_only_pages": F.lit(None).cast("array<int>")})
    return out.join(page_ops.pdf_meta(reports), "doc_id", "left")


PAGES = "doc_id string, page int, text string, ratio double, fonts array<struct<name:string,has_tounicode:boolean>>"


def pdf_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page, text, ratio (of images) and fonts of the pages of PDF documents (doc_id, content), for pages.report; broken ones have none."""
    ship(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                rows = []
                try:
                    for p in pdf.pages(bytes(content)):
                        text = "\n".join(b[4] for b in p.blocks if b[5] == 0)
                        covered = sum(max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) for b in p.blocks if b[5] == 1)
                        rows.append((doc_id, p.number, text, min(1.0, covered / p.area) if p.area > 0 else 0.0, [{"name": n, "has_tounicode": u} for n, u in p.fonts]))
                except Exception:  # noqa: BLE001 - dispatch() tells what is wrong
                    rows = []
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ("doc_id", "page", "text", "ratio", "fonts")]).astype({"page": "Int32"})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, PAGES)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Annotated documents, one JSON file each, with the file's stem as doc_id, parsed to the document's columns."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("doc_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1))
    return parse_golden(raw.select("doc_id", F.col("value").alias("json")))


def parse_golden(rows: DataFrame) -> DataFrame:
    """doc_id and the columns of annotated documents from rows (doc_id, json); the three percentages are theirs too.

    An annotation may lack parts, and its citations the kind: these are null, nothing is validated.
    """
    percents = [StructField(f"{b}_percent_of_budget", DoubleType()) for b in schema.BONDS]
    kind = StructType([*schema.DOCUMENT.fields, *percents])
    return rows.select("doc_id", F.from_json("json", kind).alias("d")).select("doc_id", "d.*")


def size_drift(pinned: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """(key, pinned, found): files whose size isn't the pinned one any more, so that another file may have taken their place."""
    return pinned.join(found, key).filter(~F.col("pinned").eqNullSafe(F.col("found"))).select(key, "pinned", "found")


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Recorded model outputs: doc_id, name, attempt, provider, model, json, counters, duration_ms, error."""
    return spark.read.schema("doc_id string, name string, attempt int, provider string, model string, json string, input_tokens bigint, output_tokens bigint, cache_write_tokens bigint, cached_read_tokens bigint, duration_ms bigint, error string").json(path)
