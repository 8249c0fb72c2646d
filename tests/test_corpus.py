"""The paper corpus: where its rows lie, and what filters make of it."""

from pyspark.sql import functions as F

from vetloom.plans import corpus


def test_one_file_of_customers_is_dealt_out(spark, small_dir):
    assert spark.read.parquet(f"{small_dir}/customer.parquet").rdd.getNumPartitions() == 1
    for rows in (corpus.people(spark, small_dir), corpus.arrivals(spark, small_dir), corpus.tokens(spark, small_dir)):
        held = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert len(held) >= 4 and max(r["count"] for r in held) < sum(r["count"] for r in held) / 2


def test_a_filter_for_texts_derives_nothing(spark, small_dir):
    plan = corpus.tokens(spark, small_dir).filter("text is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(replace" not in plan and "isnotnull(CASE" not in plan
