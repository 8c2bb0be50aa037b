"""Shuffle files of stored stages, which would stay as long as the driver keeps their plans."""

import glob
import time

from pyspark.sql import functions as F

from casedesk.session import CLEANUP, briefly, materialize
from casedesk.sources.versions import remove_bucketed, write_bucketed


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for f in glob.glob(f"{d.getPath()}/*/shuffle_*.data")}


def gone(spark, before):
    for _ in range(50):
        if not shuffle_files(spark) - before:
            return True
        time.sleep(0.1)
    return False


def test_shuffle_files_go_when_a_stage_is_stored(spark, tmp_path):
    rows = spark.range(20_000).groupBy((F.col("id") % 5_003).alias("g")).count()
    before = shuffle_files(spark)
    kept = materialize(rows, "counts")
    assert gone(spark, before)
    with briefly(rows, "counts"):
        assert gone(spark, before)
    path = str(tmp_path / "by-group")
    bucketed = write_bucketed(rows, path, 4, "g")
    assert gone(spark, before)
    assert kept.count() == bucketed.count() == rows.count() == 5_003
    assert shuffle_files(spark) - before and spark.conf.get(CLEANUP) == "false"
    remove_bucketed(spark, path)
