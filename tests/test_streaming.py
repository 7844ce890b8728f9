"""Deliveries: the second file only, a drifted header, broken rules, results that are kept, reviews of missing IDs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sieveline.functions import convert
from sieveline.operators import govern, quality
from sieveline.sources import tables
from sieveline.sources.shared import Files
from sieveline.streaming import commits, events, pipeline, rescue

WARN = {"value present": "value IS NOT NULL"}
FAIL = {"layout": "_rescued_data IS NULL"}


def deliver(spark, out, name, lines, columns=("id", "value")):
    folder = out.removeprefix("file://") + "/landing"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.csv", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    pipeline.bronze(spark, f"{out}/landing", out, list(columns))


def to_silver(spark, out):
    pipeline.silver(spark, out, "id", lambda d: d.withColumn("id", convert.to_id(F.col("id"))), WARN, FAIL)


def test_second_delivery_only(spark, tmp_path):
    out = f"file://{tmp_path}"
    deliver(spark, out, "one", ["id,value", "00000001,a", "00000002,", ",x"])
    to_silver(spark, out)
    deliver(spark, out, "two", ["id,value", '" 00000003 ",c', "12,d"])
    to_silver(spark, out)
    to_silver(spark, out)  # nothing new
    assert sorted(map(tuple, pipeline.read(spark, out, "silver").select("id", "value").collect()), key=str) == [(1, "a"), (2, None), (3, "c")]
    assert sorted((r["id"] or "", r["_id_problem"]) for r in pipeline.read(spark, out, "quarantine").collect()) == [("", "missing"), ("12", "not 8 digits")]
    assert [tuple(r) for r in tables.rows_per_file(pipeline.read(spark, out, "bronze")).orderBy("_source_file").collect()] == [("one.csv", 3), ("two.csv", 2)]
    assert [tuple(r) for r in pipeline.expectation_counts(spark, out).collect()] == [("value present", 2, 1)]
    assert "batch" not in pipeline.read(spark, out, "silver").columns


@pytest.mark.parametrize("header", ["value,id", "id,worth", "id,value,more"])
def test_changed_header_stops_the_update(spark, tmp_path, header):
    out = f"file://{tmp_path}"
    deliver(spark, out, "one", ["id,value", "00000001,a"])
    with pytest.raises(Exception, match="(?i)header|failed"):
        deliver(spark, out, "two", [header, ",".join(["00000002", "b", "c"][: header.count(",") + 1])])
    assert pipeline.read(spark, out, "bronze").count() == 1


def test_row_that_breaks_the_layout_fails_the_update(spark, tmp_path):
    out = f"file://{tmp_path}"
    deliver(spark, out, "one", ["id,value", "00000001,a,b,c"])
    assert pipeline.read(spark, out, "bronze").first()["_rescued_data"] == "00000001,a,b,c"
    with pytest.raises(Exception, match="layout"):
        to_silver(spark, out)
    assert not (tmp_path / "silver").exists()


def test_validation_keeps_its_results_and_fails(spark, tmp_path):
    out = f"file://{tmp_path}"
    deliver(spark, out, "one", ["id,value", "00000001,a", "00000001,b", ",x"])
    to_silver(spark, out)
    with pytest.raises(AssertionError, match="repeated ids.*reviewed"):
        pipeline.validate(spark, out, "id", {}, "first")
    kept = {r["check_name"]: (r["value"], r["status"]) for r in tables.read_log(spark, f"{out}/results", "").collect()}
    assert kept == {"conservation": (0.0, "PASS"), "repeated ids": (1.0, "FAIL"), "quarantined rows reviewed": (1.0, "FAIL"), "value present": (0.0, "PASS")}
    review = spark.createDataFrame([("one.csv", "", "blank line")], "_source_file string, id_written string, note string")
    pipeline.review(spark, out, review)
    assert pipeline.unreviewed(spark, out, "id").count() == 0
    assert pipeline.validate(spark, out, "id", {}, "second", raises=False).where("status = 'FAIL'").count() == 1


def test_gold_fail_rule(spark, tmp_path):
    out = f"file://{tmp_path}"
    deliver(spark, out, "one", ["id,value", "00000001,a"])
    to_silver(spark, out)
    view = {"v": lambda s: s.select("id")}
    pipeline.gold(spark, out, view, {"v": {"positive": "id > 0"}})
    assert spark.read.parquet(f"{out}/gold/v").count() == 1
    with pytest.raises(ValueError, match="beyond"):
        pipeline.gold(spark, out, view, {"v": {"beyond": "id > 9"}})


def test_null_keys_are_inserted_once(spark, tmp_path):
    rows, path = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string"), f"file://{tmp_path}/log"
    tables.insert_absent(rows, path, ["k"])
    tables.insert_absent(rows, path, ["k"])
    assert tables.read_log(spark, path, "").count() == 2


def test_gates(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id string")
    assert [r["id"] for r in quality.strict_ids(ids("00000001", "00000012"), "id").orderBy("id").collect()] == [1, 12]
    for bad in (("00000001", None), ("1",), ("00000001", "00000001")):
        with pytest.raises(ValueError):
            quality.strict_ids(ids(*bad), "id")
    with pytest.raises(ValueError):
        tables.save_reference(ids("a", "a"), "id", "file:///tmp/never")


def test_mask_and_filter(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "u int, v string")
    access = spark.createDataFrame([("me", 1), ("me", 1), ("you", 2)], "reader string, unit int")
    assert [tuple(r) for r in govern.row_filter(df, access, "u", "me").collect()] == [(1, "x")]
    assert [r[0] for r in df.select(govern.mask(F.col("v"), F.col("u") == 1)).collect()] == ["x", "RESTRICTED", "RESTRICTED"]


def counts(spark, out):
    return {p: pipeline.read(spark, out, p).count() for p in ("silver", "quarantine")}


@pytest.mark.parametrize("when", ["before the write", "before the commit", "after the commit"])
def test_killed_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch, when):
    """A driver that dies anywhere in a batch: readers keep what was committed, the next update adds the batch once."""
    out = f"file://{tmp_path}"
    deliver(spark, out, "one", ["id,value", "00000001,a", ",x"])
    to_silver(spark, out)
    deliver(spark, out, "two", ["id,value", "00000002,b", "00000003,", "1,y"])
    commit, broken = commits.CommitLog.commit, []

    def dies(self, batch, **entry):
        if when == "after the commit":
            commit(self, batch, **entry)
        broken.append(entry["folder"])
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        if when == "before the write":
            m.setattr(commits.CommitLog, "has", lambda *_: 1 / 0)
        else:
            m.setattr(commits.CommitLog, "commit", dies)
        with pytest.raises(Exception, match="killed|division"):
            to_silver(spark, out)
    done = when == "after the commit"
    assert counts(spark, out) == ({"silver": 3, "quarantine": 2} if done else {"silver": 1, "quarantine": 1})
    assert {tuple(r) for r in pipeline.expectation_counts(spark, out).collect()} == {("value present", 2, 1) if done else ("value present", 1, 0)}
    to_silver(spark, out)
    assert counts(spark, out) == {"silver": 3, "quarantine": 2}
    assert sorted(r["id"] for r in pipeline.read(spark, out, "silver").collect()) == [1, 2, 3]
    log = commits.CommitLog(spark, f"{out}/_commits")
    assert commits.sweep(spark, log, f"{out}/batches") == (broken if when == "before the commit" else [])
    assert counts(spark, out) == {"silver": 3, "quarantine": 2}


def test_commit_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "COMPACT", 4)
    log = commits.CommitLog(spark, f"file://{tmp_path}/log")
    assert log.entries() == [] and not log.has(0)
    for k in range(11):
        log.commit(k, folder=f"f{k}")
    assert [e["folder"] for e in log.entries()] == [f"f{k}" for k in range(11)] and log.has(10)
    with pytest.raises(FileExistsError):
        log.commit(10, folder="again")
    for k in range(8):  # the compacted file holds them
        log.files.delete(f"{k:012d}.json")
    assert [e["batch"] for e in log.entries()] == list(range(11))
    assert not [n for n in log.files.names() if n.startswith(".0")]
    log.clear()
    assert log.entries() == []


def test_full_refresh_and_batches_of_files(spark, tmp_path):
    out = f"file://{tmp_path}"
    for k in range(3):
        deliver(spark, out, f"d{k}", ["id,value", f"0000000{k + 1},a", "x,"])
    run = lambda n: pipeline.silver(spark, out, "id", lambda d: d.withColumn("id", convert.to_id(F.col("id"))), WARN, FAIL, files_per_batch=n)
    run(1)
    assert len(commits.CommitLog(spark, f"{out}/_commits").entries()) == 3 and counts(spark, out) == {"silver": 3, "quarantine": 3}
    pipeline.full_refresh(spark, out)
    with pytest.raises(FileNotFoundError):
        pipeline.read(spark, out, "silver")
    run(100)
    assert len(commits.CommitLog(spark, f"{out}/_commits").entries()) == 1 and counts(spark, out) == {"silver": 3, "quarantine": 3}


def put(out, name, lines):
    folder = f"{out.removeprefix('file://')}/landing"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.csv", "w", encoding="utf-8", newline="") as f:
        f.write("\r\n".join(lines))


def test_rescued_columns(spark, tmp_path):
    out = f"file://{tmp_path}"
    put(out, "agreed", ["id,value", '00000001,"a, ""b"""', "", "00000002,"])
    put(out, "added one", ["id,extra,value,", "3,,c,", "4,more,d,odd"])
    rescue.bronze_rescued(spark, f"{out}/landing", out, ["id", "value"], files_per_batch=1)
    put(out, "missing", ["﻿value", "e"])
    put(out, "moved", ["value,id,id,Value,_line", "f,5,6,g,h", "i,7", "j,8,9,k,l,m", "value,id,id,Value,_line"])
    put(out, "empty", [])
    rescue.bronze_rescued(spark, f"{out}/landing", out, ["id", "value"])
    rescue.bronze_rescued(spark, f"{out}/landing", out, ["id", "value"])  # nothing new
    got = {(r["_source_file"].split(".")[0].replace("%20", " "), r["value"]): (r["id"], r["_rescued_data"] and json.loads(r["_rescued_data"])) for r in pipeline.read(spark, out, "bronze").collect()}
    assert got == {
        ("agreed", 'a, "b"'): ("00000001", None), ("agreed", None): ("00000002", None),
        ("added one", "c"): ("3", None), ("added one", "d"): ("4", {"extra": "more", "#4": "odd"}),
        ("missing", "e"): (None, None),
        ("moved", "f"): ("5", {"id#3": "6", "Value": "g", "_line#5": "h"}), ("moved", "i"): ("7", {"_line": "i,7"}),
        ("moved", "j"): ("8", {"id#3": "9", "Value": "k", "_line#5": "l", "_line": "j,8,9,k,l,m"}),
    }
    with pytest.raises(Exception, match="layout"):
        to_silver(spark, out)
    with pytest.raises(FileNotFoundError):
        pipeline.read(spark, out, "silver")


def test_file_that_comes_between_the_streams(spark, tmp_path, monkeypatch):
    """Its header is not noted yet: the update stops, notes it and goes on, each row once."""
    out, note = f"file://{tmp_path}", rescue._note_headers
    put(out, "first", ["id,value", "1,a"])

    def late(*a):
        log = note(*a)
        if not os.path.exists(f"{tmp_path}/landing/late.csv"):
            put(out, "late", ["value,id", "b,2"])
        return log

    monkeypatch.setattr(rescue, "_note_headers", late)
    rescue.bronze_rescued(spark, f"{out}/landing", out, ["id", "value"])
    assert sorted((r["id"], r["value"]) for r in pipeline.read(spark, out, "bronze").collect()) == [("1", "a"), ("2", "b")]


def test_events_of_updates(spark, tmp_path):
    out = f"file://{tmp_path}"
    for k, lines in enumerate((["00000001,a", "00000002,"], ["00000003,", "00000004,d", "00000005,e", "x,"])):
        with events.EventLog(spark, f"{out}/_events", update_id=f"u{k}") as log:
            deliver(spark, out, f"d{k}", ["id,value", *lines])
            to_silver(spark, out)
        assert log.errors == []
    found = events.read_events(spark, f"{out}/_events")
    got = lambda u=None: {tuple(r) for r in events.expectation_metrics(found, u).collect()}
    assert got() == {("silver", "value present", 2, 1)} and got("u0") == {("silver", "value present", 1, 1)} and got("none") == set()
    assert {r["event_type"] for r in found.collect()} == {"create_update", "flow_progress", "query_ended"}


def test_gold_grows_by_deliveries(spark, tmp_path):
    """After three deliveries, and after none and a refresh, the state's view equals a recompute of all of silver."""
    out = f"file://{tmp_path}"
    partial = lambda d: d.groupBy("value", "id").agg(F.count("*").alias("n"))
    merge = lambda s: s.groupBy("value", "id").agg(F.sum("n").alias("n"))
    for k in range(3):
        deliver(spark, out, f"d{k}", ["id,value", *[f"{j % 7:08d},{'ab'[j % 2]}" for j in range(k, 9 + k * 5)]])
        to_silver(spark, out)
        for _ in range(2):
            pipeline.gold_incremental(spark, out, "v", partial, merge)
        view = pipeline.gold_state(spark, out, "v").groupBy("value").agg(F.sum("n").alias("records"), F.count("id").alias("people"))
        whole = pipeline.read(spark, out, "silver").groupBy("value").agg(F.count("*").alias("records"), F.count_distinct("id").alias("people"))
        assert sorted(map(tuple, view.collect())) == sorted(map(tuple, whole.collect()))
    assert len(commits.CommitLog(spark, f"{out}/gold_state/v/_commits").entries()) == 3


def test_repeated_ids_go_to_quarantine(spark, tmp_path):
    """Within a delivery, across deliveries, and beside rows that have no ID; a batch that ran before counts once."""
    out = f"file://{tmp_path}"
    to = lambda: pipeline.silver(spark, out, "id", lambda d: d.withColumn("id", convert.to_id(F.col("id"))), WARN, FAIL, repeats="30 days")
    deliver(spark, out, "one", ["id,value", "00000001,a", "00000002,b", "00000002,c", ",x"])
    to()
    deliver(spark, out, "two", ["id,value", "00000001,d", "00000003,e", "3,y"])
    to()
    to()
    silver = {r["id"]: r["value"] for r in pipeline.read(spark, out, "silver").collect()}
    assert silver[1] == "a" and silver[2] in "bc" and silver[3] == "e" and len(silver) == 3 == pipeline.read(spark, out, "silver").count()
    held = sorted((r["id"] or "", r["_id_problem"]) for r in pipeline.read(spark, out, "quarantine").collect())
    assert held == [("", "missing"), ("00000001", "repeated"), ("00000002", "repeated"), ("3", "not 8 digits")]
    assert pipeline.validate(spark, out, "id", {}, raises=False).where("check_name IN ('conservation', 'repeated ids') AND status = 'PASS'").count() == 2
    assert Files(spark, f"{out}/_staged").names() == []
