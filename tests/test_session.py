"""The lifetime of tables that operators write on the way."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leakfree.session import checkpoint_base, drop_stage, scratch, stored


def tables(spark):
    return set(Path(checkpoint_base(spark).removeprefix("file:")).glob("scratch-*"))


def test_a_block_owns_its_tables(spark):
    before = tables(spark)
    with scratch(spark) as outer:
        with scratch(spark) as inner:
            stored(spark.range(5))
            kept = inner.keep(stored(spark.range(7)))
            assert len(tables(spark) - before) == 3
        assert len(tables(spark) - before) == 1 and kept.count() == 7
        last = outer.keep(kept)
    assert len(tables(spark) - before) == 1 and last.count() == 7
    drop_stage(last)
    drop_stage(spark.range(1))
    assert tables(spark) == before


def test_a_block_that_fails_leaves_nothing(spark):
    before = tables(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        stored(spark.range(5))
        raise ZeroDivisionError
    assert tables(spark) == before
    stored(spark.range(3))
    assert len(tables(spark) - before) == 1


def test_shuffle_files_go_with_the_table_they_were_for(spark):
    """A chain of stored tables leaves no shuffle files behind, and the session's setting is as before."""
    def files():
        root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return sum(1 for d in root for _ in Path(d.toString()).rglob("shuffle_*.data"))

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(setting), files()
    df = spark.range(1000).withColumnRenamed("id", "k")
    for _ in range(3):
        df = stored(df.groupBy((F.col("k") % 500).alias("k")).count().select("k"))
    assert df.count() == 500
    left = lambda: files() - before
    deadline = time.time() + 20
    while left() > 1 and time.time() < deadline:  # files go in the background; the count's own may stay
        time.sleep(0.2)
    assert left() <= 1 and spark.conf.get(setting) == was


def test_a_block_bounds_the_files_of_its_tables(spark):
    """Inner blocks too; no row is lost and the bound ends with the block."""
    def files(df):
        return len(list(Path(df.stage_path.removeprefix("file:")).glob("part-*")))

    many = spark.range(0, 100, 1, 8)
    with scratch(spark, files=2), scratch(spark) as inner:
        few, kept = stored(many), inner.keep(many)
        assert files(few) == files(kept) == 2 and few.count() == kept.count() == 100
    with scratch(spark):
        assert files(stored(many)) == 8
