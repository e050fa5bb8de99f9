"""A stored table leaves nothing of what its job shuffled on disk."""

import time

from pyspark.sql import functions as F

from touchline.sources.tables import CLEANUP, materialise


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {x for x in blocks.mkString(" ").split() if x.startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_stored(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP, "false")
    dealt = spark.range(20_000).repartition(4, F.col("id") % 7).groupBy((F.col("id") % 1000).alias("k")).count()
    stored = materialise(dealt)
    for _ in range(50):  # files are deleted in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP, "false") == setting
    assert stored.agg(F.sum("count")).first()[0] == 20_000 and stored.count() == 1000
