"""What similarity queries leave on disk: no shuffle files of tables that are written, and no table that nothing reads any more."""

from __future__ import annotations

import os
import time
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from anchorlake.common import keep, shared_dir
from anchorlake.plans import registry

TABLES = "/root/testdata/sf0.001"
#: Tables that the result still reads.
LEFT = {"dup_cross_links": 1, "dup_cross_first": 2, "debt_counts": 9, "maintenance_plan": 10, "debt_next": 9}


def shuffles(spark):
    """Ids of the shuffles that have files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n.split("_")[1] for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_a_table_that_is_written_leaves_no_shuffle_files(spark):
    before = shuffles(spark)
    keep(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count())
    for _ in range(50):
        if not shuffles(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffles(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
@pytest.mark.parametrize("name", LEFT)
def test_queries_drop_the_tables_of_their_steps(spark, name):
    at = urlparse(shared_dir(spark)).path + "/anchorlake"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    got = registry.QUERIES[name](spark, TABLES)
    assert len(set(os.listdir(at)) - before) == LEFT[name]
    got.collect()
