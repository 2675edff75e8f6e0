"""What a job leaves on disk."""

import os

from pyspark.sql import functions as F

from tagloom.session import stable
from tests.conftest import rows


def test_written_tables_leave_no_shuffle_files(spark):
    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}

    before = files()
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(7).withColumnRenamed("id", "k").repartition(3), "k")
    assert rows(stable(frame)) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert files() <= before
