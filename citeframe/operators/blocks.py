"""Addressable blocks: paragraphs, table cells and spreadsheet cells; addressed text, caps, previews, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeframe.functions.text import strip
from citeframe.shared import frequent, hot_join, settle

MAX_BLOCKS = 3_000
MAX_CELLS = 5_000
MAX_VISION_PAGES = 20
MAX_VISION_BYTES = 20 * 1024 * 1024
MAX_PREVIEW_CELLS = 2_000


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, seq, kind, ref, text: the non-blank lines of docs (doc_id, text), numbered densely.

    Lines are split and numbered within the row, so a document's blocks cost no shuffle.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: strip(s)), lambda s: s != "")
    rows = docs.select("doc_id", F.posexplode(lines).alias("pos", "text"))
    seq = F.col("pos") + 1
    return rows.select("doc_id", seq.alias("seq"), F.lit("paragraph").alias("kind"), F.concat(F.lit("para:"), seq.cast("string")).alias("ref"), "text")


def paragraph_text(docs: DataFrame) -> DataFrame:
    """addressed(paragraphs(docs)) within the row, without a shuffle; documents without a block are left out."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: strip(s)), lambda s: s != "")
    rows = docs.select("doc_id", lines.alias("lines")).filter(F.size("lines") > 0)
    told = F.transform("lines", lambda x, i: F.concat(F.lit("[para:"), (i + 1).cast("string"), F.lit("] "), x))
    return rows.select("doc_id", F.array_join(told, "\n").alias("document_text"))


def addressed(blocks: DataFrame) -> DataFrame:
    """`[ref] text` lines in order, one text for each doc_id."""
    line = F.concat(F.lit("["), F.col("ref"), F.lit("] "), F.col("text"))
    return blocks.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", line.alias("line"))))["line"], "\n").alias("document_text"))


def addressed_sheets(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """sheets (doc_id, sheet_idx, sheet) and cells (doc_id, sheet_idx, row, col, ref, text): a header for every sheet, its cells below."""
    head = sheets.select("doc_id", "sheet_idx", F.lit(0).alias("row"), F.lit(0).alias("col"), F.concat(F.lit("\n[ชีท: "), F.col("sheet"), F.lit("]")).alias("line"))
    body = cells.select("doc_id", "sheet_idx", "row", "col", F.concat(F.lit("["), F.col("ref"), F.lit("] "), F.col("text")).alias("line"))
    return head.unionByName(body).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("sheet_idx", "row", "col", "line")))["line"], "\n").alias("document_text"))


def over_cap(units: DataFrame, cap: int) -> DataFrame:
    """Documents with more units than the cap; they are refused, never cut."""
    return units.groupBy("doc_id").agg(F.count("*").alias("units")).filter(F.col("units") > cap)


def vision_over_cap(images: DataFrame) -> DataFrame:
    """Documents whose rendered pages (doc_id, content) are too many or too large."""
    each = images.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("content")).alias("bytes"))
    return each.filter((F.col("pages") > MAX_VISION_PAGES) | (F.col("bytes") > MAX_VISION_BYTES))


def preview(cells: DataFrame, most: int = MAX_PREVIEW_CELLS) -> DataFrame:
    """The first cells of each sheet, row by row, and whether there are more."""
    sheet = Window.partitionBy("doc_id", "sheet")
    rows = cells.withColumn("n", F.row_number().over(sheet.orderBy("row", "col"))).withColumn("truncated", F.count("*").over(sheet) > most)
    return rows.filter(F.col("n") <= most).drop("n")


def grid_axes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, columns (by length, then letter) and rows (by number) of grids of cells (keys, ref); few for a sheet."""
    col, row = F.regexp_extract("ref", r"^([A-Z]+)(\d+)$", 1), F.regexp_extract("ref", r"^([A-Z]+)(\d+)$", 2).cast("int")
    axes = cells.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(F.length(col).alias("n"), col.alias("c")))).alias("columns"), F.sort_array(F.collect_set(row)).alias("rows"))
    return axes.select(*keys, F.transform("columns", lambda c: c["c"]).alias("columns"), "rows")


def grid(cells: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """cells (keys, ref, value) as rows by number and columns by letter; `columns` in order of length, then letter."""
    rows = cells.select(*keys, F.regexp_extract("ref", r"^([A-Z]+)(\d+)$", 1).alias("col"), F.regexp_extract("ref", r"^([A-Z]+)(\d+)$", 2).cast("int").alias("row"), "value")
    return rows.groupBy(*keys, "row").pivot("col", sorted(columns, key=lambda c: (len(c), c))).agg(F.first("value"))


def grid_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, columns, row, values of every row that has a cell (keys, ref, value), whatever columns a sheet has.

    columns: the letters of all the sheet's columns, by length, then letter; values: as many, null where there is no
    cell.  A ref that isn't letters and a number is passed over; of cells with one ref the largest value counts.  A
    sheet's axes are one row each, at most as many letters as a sheet has columns; the rows of a large sheet are shared out.
    """
    form = r"^([A-Z]+)(\d+)$"
    own = cells.filter(F.col("ref").rlike(form)).select(*keys, F.regexp_extract("ref", form, 1).alias("col"), F.regexp_extract("ref", form, 2).cast("bigint").alias("row"), "value")
    axes = own.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(F.length("col").alias("n"), "col")))["col"].alias("columns"), F.count("*").alias("c"))
    axes = settle(axes)
    # both steps by the same rows of a sheet, dealt out once
    line = own.repartition(*keys, "row").groupBy(*keys, "row", "col").agg(F.max("value").alias("value"))
    line = line.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("at"))
    often = frequent(axes.select(*keys, "c"), keys, axes.agg(F.sum("c")).first()[0] or 0)
    joined = hot_join(line, axes.drop("c"), keys, often)
    return joined.select(*keys, "columns", "row", F.transform("columns", lambda c: F.try_element_at("at", c)).alias("values"))
