"""Quality of extraction against labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.functions.text import filled, normal, ocr_match, relaxed_match

#: Which predicted field answers which labelled one, and how they are compared (fixed values).
FIELD_MAP = [
    ("pan", "pan", "pan_number", "strict"),
    ("pan", "name", "name", "relaxed"),
    ("pan", "dob", "date_of_birth", "strict"),
    ("gst", "gstin", "gstin", "ocr"),
    ("gst", "legal_name", "legal_name", "relaxed"),
    ("gst", "address", "address", "relaxed"),
    ("gst", "registration_date", "registration_date", "strict"),
    ("gst", "registration_type", "registration_type", "relaxed"),
    ("bank", "account_number", "account_number", "strict"),
    ("bank", "ifsc", "ifsc_code", "strict"),
    ("bank", "account_holder", "payee_name", "relaxed"),
]
FIELD_TARGET, PASS_RATE = 0.9, 0.8


def field_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIELD_MAP, "doc_type string, gt_key string, pred_key string, mode string")


def unpivoted(truth: DataFrame, doc_type: str) -> DataFrame:
    """(doc_type, file, gt_key, gt_value) of a kind's labelled table."""
    wanted = [g for t, g, *_ in FIELD_MAP if t == doc_type]
    return truth.unpivot("file", wanted, "gt_key", "gt_value").select(F.lit(doc_type).alias("doc_type"), "file", "gt_key", "gt_value")


def matches(mode: Column, truth: Column, predicted: Column) -> Column:
    """Whether two normal values agree in a mode."""
    return F.when(mode == "strict", truth == predicted).when(mode == "ocr", ocr_match(truth, predicted)).otherwise(relaxed_match(truth, predicted))


def counts(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """``tp``, ``fp``, ``fn`` for each (doc_type, gt_key).

    ``truth`` is as of :func:`unpivoted`; ``predictions`` has (file, field,
    value), and a file or field that is missing there counts as no value.  A
    wrong value is both a false positive and a false negative.
    """
    asked = truth.join(F.broadcast(field_map(truth.sparkSession)), ["doc_type", "gt_key"])  # eleven rows
    given = predictions.select("file", F.col("field").alias("pred_key"), "value")
    rows = asked.join(given, ["file", "pred_key"], "left").select("doc_type", "gt_key", "mode", filled(normal(F.col("gt_value"))).alias("t"), filled(normal(F.col("value"))).alias("p"))
    agree = F.coalesce(matches(F.col("mode"), F.col("t"), F.col("p")), F.lit(False))
    there, told = F.col("t").isNotNull(), F.col("p").isNotNull()
    return rows.groupBy("doc_type", "gt_key").agg(
        F.count_if(there & told & agree).alias("tp"),
        F.count_if(told & (~there | ~agree)).alias("fp"),
        F.count_if(there & (~told | ~agree)).alias("fn"),
    )


def metrics(counts_: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1_score (three digits, half to even) and support."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    raw = counts_.select("doc_type", "gt_key", share(tp, tp + fp + fn).alias("a"), share(tp, tp + fp).alias("p"), share(tp, tp + fn).alias("r"), (F.col("tp") + F.col("fn")).alias("support"))
    f1 = share(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    three = lambda c, name: F.bround(c, 3).alias(name)
    return raw.select("doc_type", "gt_key", three(F.col("a"), "accuracy"), three(F.col("p"), "precision"), three(F.col("r"), "recall"), three(f1, "f1_score"), "support")


def summary(metrics_: DataFrame) -> DataFrame:
    """One row: how many fields reach the target, their share, and the verdict."""
    both = metrics_.agg(F.count_if(F.col("accuracy") >= FIELD_TARGET).alias("passing_fields"), F.count("*").alias("total_fields"))
    rate = F.when(F.col("total_fields") > 0, F.col("passing_fields") / F.col("total_fields"))
    return both.withColumn("pass_rate", rate).withColumn("verdict", F.when(rate.isNull(), None).when(rate >= PASS_RATE, "PASSED").otherwise("NEEDS IMPROVEMENT"))


def grade(accuracy: Column) -> Column:
    """A mark for a report."""
    return F.when(accuracy >= 0.9, "✓").when(accuracy >= 0.7, "~").otherwise("✗")
