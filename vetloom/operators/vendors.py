"""From extraction results to vendors, and the format checks of vendors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.functions import identifiers as ids
from vetloom.functions.text import filled, strip

#: What each field's confidence counts (fixed values, in the order of the sum).
WEIGHTS = {"name": 1.5, "pan_number": 2.0, "gstin": 2.0, "legal_name": 1.5, "account_number": 1.0, "ifsc_code": 1.0, "payee_name": 1.5, "address": 0.5}


def value(field: str, fields: Column | str = "fields") -> Column:
    """A field's value, null if it is not there."""
    return (F.col(fields) if isinstance(fields, str) else fields)[field]["value"]


def overall_confidence(fields: Column) -> Column:
    """The weighted mean confidence of the fields that are there; 0 if there is none."""
    parts = F.array(*[F.when(F.map_contains_key(fields, k), F.struct(F.lit(w).alias("w"), (F.coalesce(fields[k]["confidence"], F.lit(0.0)) * F.lit(w)).alias("cw"))) for k, w in WEIGHTS.items()])
    there = F.filter(parts, lambda p: p.isNotNull())
    total = lambda name: F.aggregate(there, F.lit(0.0), lambda a, p: a + p[name])
    return F.when(F.size(there) > 0, total("cw") / total("w")).otherwise(F.lit(0.0))


def code(text: Column) -> Column:
    """An identifier stripped and in upper case, null if blank."""
    return filled(F.upper(strip(text)))


def map_vendors(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A vendor for each successful result with a name; ``keep`` names columns to carry along."""
    name = F.coalesce(*[filled(value(k)) for k in ("name", "legal_name", "payee_name")])
    account, ifsc = value("account_number"), value("ifsc_code")
    bank = F.when(filled(account).isNotNull() | filled(ifsc).isNotNull(), F.struct(account.alias("account_number"), code(ifsc).alias("ifsc_code"), value("payee_name").alias("account_holder")))
    vendors = results.filter("status = 'success'").select(
        *keep,
        name.alias("vendor_name"),
        code(value("pan_number")).alias("pan"),
        code(value("gstin")).alias("gstin"),
        bank.alias("bank_details"),
        value("address").alias("address"),
        F.col("document_type").alias("source_document_type"),
        F.current_timestamp().alias("extraction_timestamp"),
        overall_confidence(F.col("fields")).alias("confidence_score"),
    )
    return vendors.filter("vendor_name is not null")


def errors() -> Column:
    """All format errors of a vendor, in order; empty if it is valid.  Checksums are not checked."""
    bad = lambda text, pattern: filled(text).isNotNull() & ~ids.is_format(F.upper(text), pattern)
    ifsc = F.col("bank_details.ifsc_code")
    checks = [
        F.when(F.coalesce(F.length(strip(F.col("vendor_name"))), F.lit(0)) < 2, F.lit("vendor_name is required and must be at least 2 characters")),
        F.when(bad(F.col("pan"), ids.PAN), F.concat(F.lit("Invalid PAN format: "), F.col("pan"))),
        F.when(bad(F.col("gstin"), ids.GSTIN), F.concat(F.lit("Invalid GSTIN format: "), F.col("gstin"))),
        F.when(bad(ifsc, ids.IFSC), F.concat(F.lit("Invalid IFSC format: "), ifsc)),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def flattened(vendors: DataFrame) -> DataFrame:
    """The bank details as columns of their own."""
    bank = [F.col("bank_details.account_number").alias("bank_account"), F.col("bank_details.ifsc_code").alias("ifsc"), F.col("bank_details.account_holder").alias("account_holder")]
    return vendors.select(*[c for c in vendors.columns if c != "bank_details"], *bank)
