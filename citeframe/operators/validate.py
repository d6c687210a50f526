"""Invariants of citations and leaves, as columns that name the first broken one (null: none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from citeframe import schema
from citeframe.functions.text import PAGE_KINDS, REF_FORMATS

ERRORS = "array<struct<path:string,code:string>>"
#: Leaves whose values are enumerated.
ENUMS = {
    "procurement_method": schema.PROCUREMENT_METHODS, "key_dates[].type": schema.KEY_DATE_TYPES,
    "qualifications[].category": schema.QUALIFICATION_CATEGORIES, "qualifications[].operator": schema.QUALIFICATION_OPERATORS,
}


def source_error(source: Column) -> Column:
    kind, page, ref = source["kind"], source["page"], source["ref"]
    fits = F.lit(False)
    for k, pattern in REF_FORMATS.items():
        fits = F.when(kind == k, ref.rlike(pattern)).otherwise(fits)
    paged = kind.isin(*PAGE_KINDS)
    return (
        F.when(source.isNull(), None)
        .when(~F.coalesce(kind.isin(*schema.SOURCE_KINDS), F.lit(False)), "kind_unknown")
        .when(paged & page.isNull(), "page_missing").when(paged & ref.isNotNull(), "ref_on_page")
        .when(~paged & ref.isNull(), "ref_missing").when(~paged & page.isNotNull(), "page_on_ref")
        .when(~paged & ~fits, "ref_malformed")
    )


def sourced_error(leaf: Column) -> Column:
    return (
        F.when(~F.coalesce(leaf["confidence"].isin(*schema.CONFIDENCE), F.lit(False)), "confidence")
        .when(leaf["value"].isNull() & (F.coalesce(leaf["reason"], F.lit("")) == ""), "reason_missing")
        .when(leaf["value"].isNotNull() & leaf["source"].isNull(), "source_missing")
        .otherwise(source_error(leaf["source"]))
    )


def enum_error(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(value.isNotNull() & ~value.isin(*allowed), "not_allowed")


def node_errors(node: Column, kind: DataType, path: str) -> Column:
    """array<struct<path, code>> of every leaf under a node that breaks an invariant; items of a list share `path[]`."""
    told = lambda code: F.filter(F.array(F.struct(F.lit(path).alias("path"), code.alias("code"))), lambda x: x["code"].isNotNull())
    if isinstance(kind, ArrayType):
        every = F.flatten(F.transform(node, lambda x: node_errors(x, kind.elementType, f"{path}[]")))
        return F.when(node.isNull(), told(F.lit("missing"))).otherwise(every)
    if kind == schema.RISK_FLAG:
        allowed = F.coalesce(node["origin"].isin(*schema.ORIGINS), F.lit(False))
        return told(F.when(node["text"].isNull(), "missing").when(~allowed, "not_allowed").otherwise(source_error(node["source"])))
    if isinstance(kind, StructType) and "confidence" in kind.fieldNames():
        fits = enum_error(node["value"], ENUMS[path]) if path in ENUMS else F.lit(None).cast("string")
        return told(F.coalesce(sourced_error(node), fits))
    return F.concat(*[node_errors(node[f.name], f.dataType, f"{path}.{f.name}") for f in kind.fields])


def rejects(df: DataFrame, key: str, stage: str, code: Column, detail: Column | None = None) -> DataFrame:
    """Failures as rows: (key, stage, code, detail)."""
    return df.select(key, F.lit(stage).alias("stage"), code.alias("code"), (F.lit(None).cast("string") if detail is None else detail).alias("detail")).filter("code is not null")
