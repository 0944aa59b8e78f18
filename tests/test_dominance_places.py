"""Asks at one place are one row of the sweep, which keeps few running values."""

from pyspark.sql import functions as F

from rangeloom.plans import dominance


def test_crowded_asks(spark, monkeypatch):
    swept = []

    def watched(rows, values, *more, **how):
        swept.append((rows.count(), len(values)))
        return running(rows, values, *more, **how)

    running = dominance.running
    monkeypatch.setattr(dominance, "running", watched)
    points = spark.range(100).select(F.lit(0).cast("long").alias("space"), F.col("id").alias("x"), F.col("id").alias("y"), F.lit(1).cast("long").alias("value"))
    asks = spark.range(5000).select(F.lit(0).cast("long").alias("space"), F.col("id").alias("ask"), F.lit(49).cast("long").alias("x"), F.lit(70).cast("long").alias("y"))
    found = dominance.below(points, asks, "sum")
    assert found.groupBy("value").count().collect() == [(50, 5000)]
    ((rows, values),) = swept
    assert rows < 500 and values < 8
