"""Kinds of document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetloom.functions.text import has_any

#: What tells each kind, the first that fits (fixed values).
KINDS = [("PAN", ("INCOME TAX", "PERMANENT ACCOUNT")), ("GST", ("GSTIN", "REGISTRATION CERTIFICATE")), ("CHEQUE", ("CHEQUE", "IFSC"))]
UNKNOWN = "UNKNOWN"


def document_type(text: Column) -> Column:
    """PAN, GST, CHEQUE or UNKNOWN, by what occurs anywhere in the text; null text is UNKNOWN."""
    upper = F.upper(text)
    out = F.when(F.lit(False), F.lit(UNKNOWN))
    for kind, words in KINDS:
        out = out.when(has_any(upper, words), F.lit(kind))
    return out.otherwise(F.lit(UNKNOWN))


def sticky_type(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no", text_col: str = "text") -> DataFrame:
    """Adds ``document_type``: that of the first page up to this one that has a kind.  Pages before it stay UNKNOWN."""
    so_far = Window.partitionBy(doc_col).orderBy(page_col).rowsBetween(Window.unboundedPreceding, 0)
    known = F.nullif(document_type(F.col(text_col)), F.lit(UNKNOWN))
    return pages.withColumn("document_type", F.coalesce(F.first(known, ignorenulls=True).over(so_far), F.lit(UNKNOWN)))
