"""A task's part of a shuffle stays small, whatever the size of the input (F7)."""

from pyspark.sql import functions as F

from cohortvec.session import apply_settings


def test_joined_partitions_stay_small(spark):
    apply_settings(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 96)
    try:
        rows = spark.range(20_000_000).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"))
        # over 300 MB: by the default of 64 MB eight tasks, one per core
        assert rows.repartition("a").rdd.getNumPartitions() > 16
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
