"""The derived event log takes little room, and its rows do not depend on how many files it has."""

import gzip
import json
from datetime import datetime
from pathlib import Path

from keyloom.eventlog import read, summaries
from keyloom.queries import eventlogs
from keyloom.queries.registry import Tables


def _tables(spark, folder):
    day = datetime(2020, 1, 1)
    one = {
        "nation": ([(0, "A", 0), (1, "B", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, 0), (2, 1), (2, 1)], "c_custkey long, c_nationkey int"),
        "orders": (
            [(k, 1 + k % 2, "FOP"[k % 3], day, f"{1 + k % 2}-X") for k in range(1, 13)],
            "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string",
        ),
        "lineitem": (
            [(k or None, n, "OF"[(k + n) % 2], k * n, "RAN"[n % 3], float(n), 1.5 * k) for k in range(13) for n in range(1, 8)],
            "l_orderkey long, l_linenumber int, l_linestatus string, l_suppkey long, l_returnflag string, "
            "l_quantity double, l_extendedprice double",
        ),
    }
    for name, (rows, schema) in one.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, str(folder))


def test_log_is_compressed_and_cut_into_files_with_the_same_rows(spark, rows, tmp_path, monkeypatch):
    tables = _tables(spark, tmp_path)
    found = []
    for size in (200_000, 2):
        monkeypatch.setattr(eventlogs, "TASKS_PER_FILE", size, raising=False)
        monkeypatch.setattr(eventlogs, "APPS", 2, raising=False)
        path = Path(eventlogs._write_log(tables).removeprefix("file:"))
        files = [p for p in path.rglob("part-*")]
        assert files and all(p.suffix == ".gz" for p in files)
        events = read.read_event_log(spark, f"{path}/*", eventlogs.PATTERN)
        found.append((len(files), rows(read.event_counts(events)), rows(summaries.storage_list(events)), rows(summaries.stage_accumulables(events))))
    (few, *a), (many, *b) = found
    assert few == 2 and many > few
    assert a == b
    counts = {(app, kind): n for app, kind, n in a[0]}
    # the customer that comes twice doubles the orders of an odd key, but not their stages
    assert counts["app-1", "SparkListenerJobStart"] == 12
    assert counts["app-1", "SparkListenerTaskStart"] == 84
    assert counts["app-1", "SparkListenerStageSubmitted"] == 12


def test_columnar_events_are_compressed_files_of_one_pass(spark, tmp_path):
    (tmp_path / "log").mkdir()
    for k in range(3):
        (tmp_path / "log" / f"app-{k}").write_text('{"Event":"SparkListenerApplicationStart","Timestamp":1}\n')
    back = read.to_columnar(read.read_event_log(spark, str(tmp_path / "log")), str(tmp_path / "out"))
    assert back.count() == 3
    assert all(".zstd." in p.name for p in (tmp_path / "out").rglob("part-*"))


def _last_plan(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    return store.executionsList().apply(int(store.executionsList().size()) - 1).physicalPlanDescription()


def test_columnar_events_are_written_without_a_sort(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = ['{"Event":"SparkListenerApplicationStart","Timestamp":1}\n', '{"Event":"SparkListenerUnpersistRDD","RDD ID":1}\n']
    (tmp_path / "log" / "app-1").write_text("".join(lines * 3))
    back = read.to_columnar(read.read_event_log(spark, str(tmp_path / "log")), str(tmp_path / "out"))
    assert "Sort" not in _last_plan(spark)
    assert len(list((tmp_path / "out").glob("Event=*/part-*"))) == back.select("Event").distinct().count() == 2
    assert back.count() == 6
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_writing_the_log_leaves_no_shuffle_files(spark, tmp_path):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {name for f in files.getAllFiles().mkString(" ").split() if (name := f.rsplit("/", 1)[-1]).startswith("shuffle_")}
    tables = _tables(spark, tmp_path)
    before = shuffled()
    path = Path(eventlogs._write_log(tables).removeprefix("file:"))
    assert not shuffled() - before
    for file in path.rglob("part-*"):
        with gzip.open(file, "rt") as lines:
            seen = [json.loads(line) for line in lines]
        for k, line in enumerate(seen):  # what is unpersisted comes after all tasks of its order
            if line["Event"] == "SparkListenerUnpersistRDD" and line not in seen[k + 1 :]:
                assert not any(x.get("Stage ID", 0) // 2 == line["RDD ID"] for x in seen[k + 1 :])
