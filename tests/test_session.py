"""Session helpers restore what they change."""

from linkloom.session import co_partitioned, spread


def test_co_partitioned_restores_settings(spark):
    keys = co_partitioned.SETTINGS
    before = [spark.conf.get(k, None) for k in keys]
    with co_partitioned(spark, 3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        assert spark.conf.get("spark.sql.adaptive.enabled") == "false"
        assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.enabled") == "false"
    assert [spark.conf.get(k, None) for k in keys] == before


def test_spread_only_small_inputs(spark):
    cores = spark.sparkContext.defaultParallelism
    small = spark.range(10).coalesce(1)
    assert spread(small).rdd.getNumPartitions() == cores
    big = spark.range(0, 100, numPartitions=cores * 2)
    assert spread(big) is big
