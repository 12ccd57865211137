import shutil
from pathlib import Path

from leakfree import adapters as A
from leakfree.session import stored

from conftest import rows


def test_published_frames_are_built_once_and_again_if_cleared_or_stale(spark, sf, tmp_path):
    source = str(tmp_path / "data")  # files of the test's own: the given ones are read-only
    Path(source).mkdir()
    for f in Path(sf).glob("*.parquet"):
        shutil.copyfile(f, f"{source}/{f.name}")
    first = rows(A.seasons(spark, source))
    key = next(k for k in A._PUBLISHED if k[1:] == (source, "seasons"))
    path = A._PUBLISHED[key][0]
    assert rows(A.seasons(spark, source)) == first and A._PUBLISHED[key][0] == path
    shutil.rmtree(next(Path(path.removeprefix("file:")).glob("season=*")))
    assert rows(A.seasons(spark, source)) == first and A._PUBLISHED[key][0] != path
    Path(f"{source}/orders.parquet").unlink()
    spark.read.parquet(f"{sf}/orders.parquet").where("o_orderkey % 2 = 0").write.parquet(f"{source}/orders.parquet")
    assert 0 < len(rows(A.seasons(spark, source))) < len(first)


def test_stored_tables_keep_rows_and_prune_columns(spark):
    df = spark.createDataFrame([(1, 2022, None), (2, 2023, [1.5])], "k int, season int, v array<double>")
    again = stored(df, "demo", "season")
    assert rows(again.select("k", "season")) == [(1, 2022), (2, 2023)]
    plan = again.where("season = 2022").select("k")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan and "ReadSchema: struct<k:int>" in plan


def test_weekly_rows_move_before_they_are_summed(spark, sf):
    """A scan's task holds no groups: the first aggregate over lineitem lies above a shuffle."""
    lines = A.weekly.__wrapped__(spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, x in enumerate(lines) if "l_shipdate" in x and "Scan parquet" in x)
    above = [next(n for n in ("Exchange", "Aggregate") if n in x) for x in reversed(lines[:scan]) if "Exchange" in x or "Aggregate" in x]
    assert above[0] == "Exchange"


def test_weekly_rows_get_partitions_by_the_size_of_their_table(spark, sf, monkeypatch):
    """A fixed number of partitions would make each task's groups grow with the input."""
    want = rows(A.weekly(spark, sf))
    monkeypatch.setattr(A, "PART_BYTES", -(-Path(f"{sf}/lineitem.parquet").stat().st_size // 37))
    many = A.weekly.__wrapped__(spark, sf)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert ", 37), REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning(player_id") <= 2
    assert rows(many.select(*A.weekly(spark, sf).columns)) == want
