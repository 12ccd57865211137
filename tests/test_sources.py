import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from leakfree.session import scratch_path
from leakfree.sources import contracts as C
from leakfree.sources import provenance as PV
from leakfree.sources import scans as S
from leakfree.sources.registry import DATASETS, Dataset
from leakfree.sources.versions import VersionedParts
from leakfree.streaming import refresh as ST

from conftest import by, rows

SEASONAL = Dataset("demo", True, frozenset({"season", "v"}), (frozenset({"a", "b"}),))


def test_registry_has_every_dataset():
    assert len(DATASETS) == 14
    assert sum(d.seasonal for d in DATASETS.values()) == 9


def test_contract_failures(spark):
    good = spark.createDataFrame([(2024, 1, 2), (None, 1, 2)], "season int, v int, a int")
    assert C.validate(good, SEASONAL, 2024) == 2
    for df, season, message in (
        (good.drop("v"), 2024, "missing required"), (good.drop("a"), 2024, "expected one of"), (good.limit(0), 2024, "no rows"),
        (good, 2023, "found"), (good.where("season is null"), 2024, "no valid season"),
    ):
        with pytest.raises(C.ContractError, match=message):
            C.validate(df, SEASONAL, season)


def test_each_team_keeps_its_latest_snapshot(spark):
    df = spark.createDataFrame([("A", "2025-08-01", 1), ("A", "2025-09-01", 2), ("B", "2025-07-01", 3)], "team string, dt string, gsis_id int")
    assert rows(C.normalize_depth(df, 2025), "team", "gsis_id", "season") == [("A", 2, 2025), ("B", 3, 2025)]
    old = spark.createDataFrame([("A", 1)], "team string, week int")
    assert rows(C.normalize_depth(old, 2020), "team", "season") == [("A", 2020)]


def test_publish_replaces_only_its_seasons(spark):
    path = scratch_path(spark, "t")
    first = spark.createDataFrame([(1, 2022), (2, 2023)], "v int, season int")
    assert PV.publish(first, path) == 2
    assert PV.publish(spark.createDataFrame([(9, 2023), (8, 2023)], "v int, season int"), path) == 2
    assert rows(spark.read.parquet(path), "v", "season") == [(1, 2022), (8, 2023), (9, 2023)]


def test_ingest_collects_failures(spark):
    ok = spark.createDataFrame([(2024, 1, 1)], "season int, v int, a int")
    def broken():
        raise OSError("gone")
    root = scratch_path(spark, "root")
    failures = PV.ingest([(SEASONAL, 2024, lambda: ok), (SEASONAL, 2023, lambda: ok), (SEASONAL, 2022, broken)], root)
    assert [f[0] for f in failures] == ["demo_2023", "demo_2022"]
    assert spark.read.parquet(f"{root}/demo").count() == 1


def test_manifest_backfills_once_and_refreshes_the_running_season(spark):
    path = scratch_path(spark, "lake")
    PV.publish(spark.createDataFrame([(1, 2022), (2, 2023), (3, 2024)], "v int, season int"), path)
    entries = PV.backfill(spark, path, "demo", "src", None)
    assert sorted(r["rows"] for r in entries.collect()) == [1, 1, 1]
    manifest = scratch_path(spark, "manifest")
    PV.append_manifest(entries, manifest)
    known = spark.read.parquet(manifest)
    assert PV.backfill(spark, path, "demo", "src", known).count() == 0
    listing = PV.list_files(spark, path).withColumns({
        "path": F.regexp_replace("path", "^file:/+", "file:///"), "season": F.regexp_extract("path", "season=([0-9]+)", 1).cast("int")})
    assert rows(PV.pending_files(listing, known, "season", 2024), "season") == [(2024,)]
    assert PV.pending_files(listing, known, "season", 2024, force=True).count() == 3


def test_fingerprint_is_that_of_the_sorted_json(spark):
    files = {"b.parquet": "22", "a.parquet": "11"}
    df = spark.createDataFrame(list(files.items()), "path string, sha256 string")
    want = hashlib.sha256(json.dumps(files, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert PV.fingerprint(df).first()["asset_set_sha256"] == want


def test_union_by_name_reconciles_types(spark):
    a = spark.createDataFrame([("1", "x")], "n string, only_a string")
    b = spark.createDataFrame([(2, 3.0)], "n int, only_b double")
    out = S.union_by_name([a, b], {"n": "int"})
    assert rows(out, "n", "only_a", "only_b") == [(1, "x", None), (2, None, 3.0)]


def test_line_text(spark):
    lines = spark.createDataFrame([("player,market,line,over,under",), ("A, receptions , 5.5,-110,-110",), ("B,receptions,x,1,2",), ("C,receptions,5",)], "value string")
    assert rows(S.parse_line_text(lines)) == [("A", "receptions", 5.5, -110.0, -110.0)]


def test_name_lists(spark):
    df = spark.createDataFrame([(1, 'player\n"Ann Lee",QB\n\n Bob \n'), (2, "Cid\nplayer")], "id int, text string")
    assert rows(S.parse_name_lists(df, "id", "text"), "id", "player") == [(1, "Ann Lee"), (1, "Bob"), (2, "Cid"), (2, "player")]


def test_live_rows(spark):
    blob = {
        "1": {"gsis_id": " 00-1 ", "full_name": "Ann Lee Jr.", "position": "WR", "team": "A", "injury_status": "IR", "news_updated": 1700000000000},
        "2": {"full_name": "Duplicate Player", "position": "WR", "team": "A"}, "3": {"full_name": "X", "position": "WR", "team": None},
        "4": "text", "5": None, "6": {"full_name": "Bo", "position": "LT", "team": "B", "gsis_id": "", "injury_status": ""},
    }
    df = spark.createDataFrame([(json.dumps(blob),)], "value string")
    assert rows(S.live_rows(df), "gsis_id", "name_key", "live_code", "news_date") == [
        ("00-1", "annlee", "IR", dt.date(2023, 11, 14)), (None, "bo", None, None)]


def test_lineup_tokens(spark):
    df = spark.createDataFrame([(1, json.dumps(["QB", "RB", "flex", "SUPER_FLEX", "REC_FLEX", "WRRB_FLEX", "D/ST", "BN", "IDP_FLEX"])), (2, "[]")], "id int, p string")
    got = {r["id"]: r.asDict() for r in S.lineup_slots(df, "id", "p").collect()}
    assert (got[1]["QB"], got[1]["DEF"], got[1]["flex"], got[1]["superflex"], got[1]["wrte"], got[1]["rbwr"]) == (1, 1, 2, 1, 1, 1)
    assert got[2]["QB"] == 0


def test_rankings_keep_the_best(spark):
    df = spark.createDataFrame([("QB1 Josh Allen (22) RB1 Bijan Robinson (3)",), ("WR2 Ja'Marr Chase (1)\nQB Josh Allen (20)",)], "text string")
    assert by(S.parse_rankings(df), "player", "adp") == {"Josh Allen": 20, "Bijan Robinson": 3, "Ja'Marr Chase": 1}


def test_streams_resume_and_merge(spark):
    landing, target, ckpt = (scratch_path(spark, n) for n in ("landing", "target", "ckpt"))
    def arrive(data):
        spark.createDataFrame(data, "k int, ts int, season int, v int, a int").coalesce(1).write.mode("append").parquet(landing)
    schema = "k int, ts int, season int, v int, a int"
    arrive([(1, 1, 2022, 5, 0), (2, 1, 2023, 6, 0)])
    ST.refresh_lake(ST.file_stream(spark, landing, schema), target, SEASONAL, ckpt)
    arrive([(1, 2, 2023, 7, 0)])
    ST.refresh_lake(ST.file_stream(spark, landing, schema), target, SEASONAL, ckpt)
    assert rows(spark.read.parquet(target), "k", "season", "v") == [(1, 2022, 5), (1, 2023, 7), (2, 2023, 6)]

    latest, ckpt2 = scratch_path(spark, "latest"), scratch_path(spark, "ckpt2")
    ST.upsert_latest(ST.file_stream(spark, landing, schema), latest, ["k"], ["ts"], ckpt2)
    arrive([(2, 9, 2024, 1, 0), (3, 1, 2024, 2, 0)])
    table = ST.upsert_latest(ST.file_stream(spark, landing, schema), latest, ["k"], ["ts"], ckpt2)
    assert rows(table.current(), "k", "ts", "v") == [(1, 2, 7), (2, 9, 1), (3, 1, 2)]


@pytest.mark.parametrize("runs", [1, 2])
def test_a_season_in_several_batches_and_runs_keeps_all_rows(spark, runs):
    landing, target, ckpt = (scratch_path(spark, n) for n in ("landing", "target", "ckpt"))
    schema = "k int, ts int, season int, v int, a int"
    for run in range(runs):
        part = [(i, 1, 2022, i, 0) for i in range(20) if i % runs == run]
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(landing)
        ST.refresh_lake(ST.file_stream(spark, landing, schema, files_per_batch=1), target, SEASONAL, ckpt)
    assert rows(spark.read.parquet(target), "k") == [(i,) for i in range(20)]
    with pytest.raises(Exception, match="source_file"):
        ST.refresh_lake(ST.file_stream(spark, landing, schema), target, SEASONAL, scratch_path(spark, "ckpt"), lambda b: b.drop("source_file"))


def test_a_replacement_is_seen_whole_or_not_at_all(spark, monkeypatch):
    path = scratch_path(spark, "versions")
    lake = VersionedParts(spark, path, ["season", "team"])
    schema = "v int, season int, team string"
    assert lake.current() == {} and rows(lake.read(schema)) == []
    assert lake.replace(spark.createDataFrame([(1, 2022, "a/b"), (2, 2022, None), (3, 2023, "x")], schema)) == 3
    assert rows(lake.read(schema), "v", "season", "team") == [(1, 2022, "a/b"), (2, 2022, None), (3, 2023, "x")]

    def broken(self, fresh):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(VersionedParts, "_rename", broken)
        with pytest.raises(OSError, match="lost"):
            lake.replace(spark.createDataFrame([(7, 2022, "a/b"), (8, 2023, "x")], schema))
    assert rows(lake.read(schema), "v") == [(1,), (2,), (3,)]
    assert lake.replace(spark.createDataFrame([(7, 2022, "a/b"), (9, 2024, "x")], schema)) == 2
    assert rows(lake.read(schema), "v") == [(2,), (3,), (7,), (9,)]
    assert lake.replace(spark.createDataFrame([], schema)) == 0
    assert lake.clean() == 3 and rows(lake.read(schema), "v") == [(2,), (3,), (7,), (9,)]


def test_a_batch_rewrites_only_the_buckets_it_touches(spark):
    schema = spark.createDataFrame([], "k int, ts int, v int").schema
    table = ST.LatestTable(spark, scratch_path(spark, "latest"), schema, ["k"], ["ts"], 16)
    table.merge(spark.createDataFrame([(k, 1, k) for k in range(200)], schema))
    before = table.parts.current()
    batch = spark.createDataFrame([(3, 2, -3), (3, 0, -9), (777, 1, 5)], schema)
    for _ in range(2):  # a batch that is repeated changes nothing
        table.merge(batch, 1)
        after = table.parts.current()
        assert len(before) == 16 and 1 <= sum(after[b] != before[b] for b in before) <= 2
        assert rows(table.current()) == sorted([(k, 1, k) for k in range(200) if k != 3] + [(3, 2, -3), (777, 1, 5)])


def test_digests_read_files_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(PV, "CHUNK", 100)
    path = scratch_path(spark, "digested")
    spark.range(5000).repartition(3).write.parquet(path)
    got = PV.provenance(spark, path, "demo", "src").collect()
    assert len(got) == 3
    for r in got:
        assert r.sha256 == hashlib.sha256(open(r.path.removeprefix("file://"), "rb").read()).hexdigest() and r.bytes > 500
    plan = PV.digests(PV.list_files(spark, path))._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def test_a_bad_batch_changes_nothing(spark):
    landing, target = scratch_path(spark, "landing"), scratch_path(spark, "target")
    spark.createDataFrame([(1, 2022)], "v int, season int").write.parquet(landing)
    with pytest.raises(Exception, match="expected one of"):
        ST.refresh_lake(ST.file_stream(spark, landing, "v int, season int"), target, SEASONAL, scratch_path(spark, "ckpt"))
    with pytest.raises(Exception):
        spark.read.parquet(target)
