import os
import time

from wayline import storage

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _local_dirs(spark):
    return [d.toString() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]


def test_shuffle_files_go_with_the_write(spark):
    def held():
        return sum(name.startswith("shuffle_") for top in _local_dirs(spark) for _, _, names in os.walk(top) for name in names)

    before, setting = held(), spark.conf.get(CLEANUP)
    written = storage.materialise(spark.range(20_000).selectExpr("id % 1000 AS k").repartition(8, "k").groupBy("k").count(), "rows")
    for _ in range(20):  # they are deleted in the background
        if held() <= before:
            break
        time.sleep(0.5)
    assert held() <= before and written.count() == 1000
    assert spark.conf.get(CLEANUP) == setting
