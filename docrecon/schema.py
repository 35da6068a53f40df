"""Column lists and Spark types of the bill candidate and its companions."""

from __future__ import annotations

from pyspark.sql import types as T

# The contract's field names, in its order.
STRING_FIELDS = [
    "documentType", "originalDocumentNumber", "documentBookNumber", "payeeType",
    "sellerName", "sellerAddress", "sellerTaxId", "sellerBranch",
    "buyerName", "buyerAddress", "buyerTaxId", "buyerBranch",
    "paymentMethod", "exchangeRateSource",
]
NUMBER_FIELDS = [
    "originalTotal", "exchangeRate", "amountBeforeVat", "vat", "vatExemptAmount", "vatRate",
    "withholdingTax", "withholdingTaxRate", "clearingAmount", "discount",
]
DATE_FIELDS = ["documentDate", "currency"]
CELL_FIELDS = STRING_FIELDS + NUMBER_FIELDS + DATE_FIELDS
ITEM_STRINGS = ["description", "unit"]
ITEM_FIELDS = ["description", "quantity", "unit", "unitPrice", "discount", "amount"]
PARTY_PARTS = ["Name", "Address", "TaxId", "Branch"]
BILL_MONEY = ["originalTotal", "amountBeforeVat", "clearingAmount"]
PHANTOM_MONEY = ["originalTotal", "amountBeforeVat", "clearingAmount", "vat", "withholdingTax"]
PAYEE_TYPES = ["company", "individual"]
AMOUNT_FIELDS = [
    "originalTotal", "amountBeforeVat", "vat", "withholdingTax", "clearingAmount",
    "discount", "vatExemptAmount",
]
RATE_FIELDS = ["vatRate", "withholdingTaxRate"]


def cell_type(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("value", kind), T.StructField("confidence", T.DoubleType())])


STRING_CELL = cell_type(T.StringType())
NUMBER_CELL = cell_type(T.DoubleType())

LINE_ITEM = T.StructType(
    [T.StructField(f, STRING_CELL if f in ITEM_STRINGS else NUMBER_CELL) for f in ITEM_FIELDS]
)
REGION = T.StructType(
    [T.StructField(f, T.IntegerType()) for f in ("chunkPageIndex", "xMin", "yMin", "xMax", "yMax")]
)

# What the model returns for one bill.
MODEL_CANDIDATE = T.StructType(
    [T.StructField(f, STRING_CELL) for f in STRING_FIELDS]
    + [T.StructField(f, NUMBER_CELL) for f in NUMBER_FIELDS]
    + [T.StructField(f, STRING_CELL) for f in DATE_FIELDS]
    + [T.StructField("lineItems", T.ArrayType(LINE_ITEM))]
)
MODEL_RESPONSE = T.StructType([T.StructField("billCandidates", T.ArrayType(MODEL_CANDIDATE))])


def is_number(field: str) -> bool:
    return field in NUMBER_FIELDS or field in ("quantity", "unitPrice", "amount")


def cell_sql_type(field: str) -> str:
    kind = "double" if is_number(field) else "string"
    return f"struct<value:{kind},confidence:double>"
