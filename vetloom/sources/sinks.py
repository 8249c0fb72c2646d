"""Reports and JSON of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetloom.operators.evaluate import grade


def result_lines(results: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): a report of each extraction result."""
    fields = F.transform(F.map_entries("fields"), lambda e: F.format_string("  %s: %s (confidence: %.2f)", e["key"], e["value"]["value"], e["value"]["confidence"]))
    good = F.when(F.size(fields) > 0, F.concat(F.array(F.lit("Extracted Fields:")), fields)).otherwise(F.array(F.lit("No fields extracted.")))
    body = F.when(F.col("status") == "success", good).otherwise(F.array(F.concat(F.lit("Error: "), F.coalesce("message", F.lit("Unknown error")))))
    head = F.array(F.concat(F.lit("Document Type: "), "document_type"), F.concat(F.lit("Status: "), "status"))
    return results.select("doc_id", F.posexplode(F.concat(head, body)).alias("line_no", "line"))


def metric_lines(metrics: DataFrame) -> DataFrame:
    """(doc_type, gt_key, line): a report of each field's metrics."""
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    parts = [F.concat(grade(F.col("accuracy")), F.lit(" Accuracy: "), percent("accuracy")), *[F.concat(F.lit(f"{n}: "), percent(c)) for n, c in (("Precision", "precision"), ("Recall", "recall"), ("F1 Score", "f1_score"))], F.concat(F.lit("Support: "), F.col("support").cast("string"))]
    return metrics.select("doc_type", "gt_key", F.concat_ws(", ", *parts).alias("line"))


def as_json(results: DataFrame) -> DataFrame:
    """(doc_id, json): each result as an object; nulls are left out."""
    return results.select("doc_id", F.to_json(F.struct("document_type", "status", "message", "fields")).alias("json"))
