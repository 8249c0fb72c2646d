"""Schemas of the tables that the engine reads and writes; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, D, L, I, B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()
POINT = _struct(x=D, y=D)
#: Recognised text: ``tok_idx`` is the order in which the recogniser gave it, the first point of a box its top left.
TOKENS = _struct(doc_id=S, page_no=I, tok_idx=I, box=T.ArrayType(POINT), text=S, conf=D)
FIELD = _struct(value=S, confidence=D)
RESULTS = _struct(doc_id=S, document_type=S, status=S, message=S, fields=T.MapType(S, FIELD))
BANK = _struct(account_number=S, ifsc_code=S, account_holder=S)
VENDORS = _struct(arrival_seq=L, vendor_name=S, pan=S, gstin=S, bank_details=BANK, address=S, source_document_type=S, extraction_timestamp=T.TimestampType(), confidence_score=D)
REGISTRY = _struct(
    arrival_seq=L, vendor_id=S, erp_reference=S, vendor_name=S, pan=S, gstin=S, bank_account=S, ifsc=S, account_holder=S, address=S, source_document_type=S, extraction_timestamp=T.TimestampType(), confidence_score=D, created_at=T.TimestampType()
)
PAN_TRUTH = _struct(file=S, name=S, pan=S, dob=S, father_name=S)
GST_TRUTH = _struct(file=S, legal_name=S, gstin=S, address=S, registration_date=S, registration_type=S)
BANK_TRUTH = _struct(file=S, document_type=S, bank_name=S, account_holder=S, account_number=S, ifsc=S, branch=S)
TRUTH = {"pan": PAN_TRUTH, "gst": GST_TRUTH, "bank": BANK_TRUTH}
