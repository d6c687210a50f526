"""The nested document: leaves that carry value, citation, confidence and reason."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

CONFIDENCE = ("high", "medium", "low")
SOURCE_KINDS = ("text_page", "vision_page", "paragraph", "table_cell_docx", "cell_xlsx")
DOCUMENT_KINDS = ("pdf", "docx", "xlsx")
ORIGINS = ("model", "derived")
# The enumerations of the document format.
PROCUREMENT_METHODS = ("e-bidding", "คัดเลือก", "เฉพาะเจาะจง")
KEY_DATE_TYPES = ("ขอรับเอกสาร", "ชี้แจงรายละเอียด", "ยื่นข้อเสนอ", "เสนอราคา", "ประกาศผล")
QUALIFICATION_CATEGORIES = ("ทุนจดทะเบียน", "ผลงานที่ผ่านมา", "ใบอนุญาต", "บุคลากร", "เครื่องจักร", "มาตรฐาน", "อื่น ๆ")
QUALIFICATION_OPERATORS = ("ไม่น้อยกว่า", "ไม่เกิน", "เท่ากับ", "อย่างน้อย")

S, D, I, L = StringType(), DoubleType(), IntegerType(), ArrayType(StringType())
SOURCE = StructType([StructField("kind", S), StructField("quote", S), StructField("page", I), StructField("ref", S)])


def sourced(of: DataType) -> StructType:
    return StructType([StructField("value", of), StructField("source", SOURCE), StructField("confidence", S), StructField("reason", S)])


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


def _leaves(**fields: DataType) -> StructType:
    return _struct(**{k: sourced(v) for k, v in fields.items()})


KEY_DATE = _leaves(type=S, date_be=S, time=S, location=S)
BOND = _leaves(amount=D, percent_stated=D, accepted_forms=L)
QUALIFICATION = _leaves(text=S, category=S, operator=S, value=D, unit=S)
DELIVERABLE = _leaves(phase=S, description=S, days_from_signing=I, payment_percent=D)
RISK_FLAG = _struct(text=S, origin=S, source=SOURCE)

#: What each extraction call returns.
GROUPS: dict[str, StructType] = {
    "basic_info": _leaves(project_name=S, project_id=S, agency=S, announcement_date=S, procurement_method=S, budget_amount=D, median_price=D),
    "key_dates": _struct(key_dates=ArrayType(KEY_DATE)),
    "bonds": _struct(bid_bond=BOND, contract_bond=BOND, warranty_bond=BOND),
    "qualifications": _struct(qualifications=ArrayType(QUALIFICATION)),
    "deliverables": _struct(deliverables=ArrayType(DELIVERABLE)),
    "misc": _struct(
        penalty=_leaves(rate_percent_per_day=D, cap_percent=D), required_documents=ArrayType(sourced(S)),
        evaluation_criteria=_leaves(method=S, price_weight=D, technical_weight=D, sub_criteria=L), risk_flags=ArrayType(RISK_FLAG),
        contact=_leaves(name_redacted=S, department=S, phone=S, email=S),
    ),
}
DOCUMENT = StructType([f for g in GROUPS.values() for f in g.fields])
BONDS = ("bid_bond", "contract_bond", "warranty_bond")


def json_schema(kind: DataType, strict: bool = True) -> dict:
    """A Spark type as JSON Schema; strict: all properties required, no others allowed."""
    if isinstance(kind, StructType):
        out = {"type": "object", "properties": {f.name: json_schema(f.dataType, strict) for f in kind.fields}}
        return out | {"required": [f.name for f in kind.fields], "additionalProperties": False} if strict else out
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType, strict)}
    return {"type": {"string": ["string", "null"], "double": ["number", "null"], "integer": ["integer", "null"]}.get(kind.typeName(), ["string", "null"])}
