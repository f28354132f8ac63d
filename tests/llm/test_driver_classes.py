"""Stored tables share generated classes, which the driver keeps, between rounds of the same plans."""

from pyspark.sql import functions as F

from turnmill.llm import blocks, components


def test_rounds_share_classes(spark):
    compiled = lambda: spark.sparkContext._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME().getCount()
    made = []
    for n in (60, 61, 62):
        before = compiled()
        components.components(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).count()
        made.append(compiled() - before)
    assert made[-1] < 8
    assert spark.conf.get(blocks._CLASS_IDS, None) is None
