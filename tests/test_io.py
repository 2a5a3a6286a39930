"""Files, pipes, actions and shared variables."""

import gzip
import threading
import time

import pytest
from pyspark.sql import functions as F

from keyloom import sinks, sources
from keyloom.operators import actions, persistence
from keyloom.operators import shared_variables as shared
from keyloom.operators.pipe import pipe


@pytest.fixture
def four(spark):
    return spark.createDataFrame([(str(i),) for i in range(1, 5)], "value string").coalesce(2)


@pytest.mark.parametrize("codec", [None, "gzip", "bzip2"])
def test_text(spark, four, tmp_path, codec):
    path = str(tmp_path / "out")
    sinks.save_as_text(four, path, line=F.col("value"), compression=codec)
    assert sorted(r[0] for r in sources.text_file(spark, path).collect()) == ["1", "2", "3", "4"]
    with pytest.raises(Exception, match="exists"):
        sinks.save_as_text(four, path)
    sinks.save_as_text(four, path, overwrite=True)
    assert '{"value":"1"}' in [r[0] for r in sources.text_file(spark, path).collect()]


def test_path_lists(spark, four, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.save_as_text(four, a, line=F.col("value"))
    sinks.save_as_text(four, b, line=F.col("value"))
    assert sources.text_file(spark, f"{a},{b}").count() == 8
    assert sources.text_file(spark, str(tmp_path / "*")).count() == 8


@pytest.mark.parametrize("codec", [None, "org.apache.hadoop.io.compress.DefaultCodec"])
def test_sequence(spark, tmp_path, codec):
    path = str(tmp_path / "seq")
    df = spark.createDataFrame([(1, "a"), (2, "aa"), (3, "aaa")], "k long, v string")
    sinks.save_as_sequence(df, path, codec)
    back = sources.sequence_file(spark, path, "k long, v string")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a"), (2, "aa"), (3, "aaa")]
    with pytest.raises(ValueError):
        sinks.save_as_sequence(df.select("k"), path + "2")
    with pytest.raises(Exception, match="exists"):
        sinks.save_as_sequence(df, path)


def test_fixed_records(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(bytes([1, 2, 3, 4, 5, 6]) * 10)
    path = str(tmp_path / "f.bin")
    records = sources.fixed_records(spark, path, 6, split_bytes=20)
    assert [bytes(r[0]) for r in records.collect()] == [bytes([1, 2, 3, 4, 5, 6])] * 10
    assert records.rdd.getNumPartitions() == 4
    with pytest.raises(Exception, match="not a multiple"):
        sources.fixed_records(spark, path, 7).collect()
    with pytest.raises(ValueError):
        sources.fixed_records(spark, path, 0)


def test_whole_and_binary(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {"a.txt": "one\ntwo\n", "b.txt": "x" * 1000, "c.txt": ""}
    for name, text in texts.items():
        (folder / name).write_text(text)
    with gzip.open(folder / "d.txt.gz", "wt") as f:
        f.write("packed\n")
    got = {r["path"].rsplit("/", 1)[1]: r["content"] for r in sources.whole_text_files(spark, str(folder)).collect()}
    assert got["a.txt"] == "one\ntwo\n" and got["b.txt"] == "x" * 1000 and got["d.txt.gz"] == "packed\n"
    files = {r["path"].rsplit("/", 1)[1]: r["length"] for r in sources.binary_files(spark, str(folder)).collect()}
    assert files["b.txt"] == 1000 and files["c.txt"] == 0


def test_pipe(four, spark, tmp_path):
    assert sorted(r[0] for r in pipe(four, "cat").collect()) == ["1", "2", "3", "4"]
    headed = pipe(four.coalesce(1), ["cat"], header=["h1", "h2"])
    assert [r[0] for r in headed.collect()][:2] == ["h1", "h2"]
    doubled = pipe(four, "cat", write_row=lambda item, put: [put(item), put(item + "_")])
    assert doubled.count() == 8
    env = pipe(four.coalesce(1), ["printenv", "KL_TEST"], env={"KL_TEST": "blue"})
    assert [r[0] for r in env.collect()] == ["blue"]
    with pytest.raises(Exception, match="ended with code"):
        pipe(four, ["cat", "no_such_file_here"]).collect()
    folders = pipe(four.repartition(3), "pwd", separate_dir=True)
    names = [r[0] for r in folders.collect()]
    assert len(set(names)) == len(names)
    many = spark.range(200_000).select(F.col("id").cast("string").alias("v"))
    assert pipe(many, "cat").count() == 200_000
    with pytest.raises(ValueError):
        pipe(four, "")


def test_persistence(spark):
    df = spark.range(100)
    kept = persistence.persist(df, "DISK_ONLY")
    assert kept.storageLevel.useDisk and not kept.storageLevel.useMemory
    with pytest.raises(ValueError):
        persistence.persist(kept, "MEMORY_ONLY")
    persistence.unpersist(kept, blocking=True)
    assert not kept.storageLevel.useDisk
    with pytest.raises(ValueError):
        persistence.persist(df, "TAPE")
    cut = persistence.checkpoint(df.groupBy((F.col("id") % 3).alias("k")).count())
    assert "Exchange" not in persistence.describe_lineage(cut)
    assert cut.count() == 3


def test_async_actions(spark):
    df = spark.range(0, 100, 1, 4)
    assert actions.count_async(df).result(60) == 100
    assert len(actions.collect_async(df).result(60)) == 100
    future = actions.take_async(df, 7)
    assert len(future.result(60)) == 7 and future.is_completed and future.job_ids()
    total = shared.accumulator(spark, 0)
    actions.foreach_async(df, lambda row: total.add(row[0])).result(60)
    assert total.value == 4950
    seen = shared.accumulator(spark, 0)
    actions.foreach_partition_async(df, lambda rows: seen.add(sum(1 for _ in rows))).result(60)
    assert seen.value == 100


def slow_rows(spark, seconds=0.5, parts=64):
    def wait(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    return spark.range(0, parts, 1, parts).mapInPandas(wait, "id long")


def test_cancel(spark):
    future = actions.count_async(slow_rows(spark))
    time.sleep(1.0)
    with pytest.raises(TimeoutError):
        future.result(0.01)
    future.cancel()
    with pytest.raises(Exception, match="(?i)cancel"):
        future.result(60)
    assert future.is_cancelled


def test_cancel_group(spark):
    errors = []

    def run():
        try:
            with actions.job_group(spark, "slow-ones", "to be stopped"):
                slow_rows(spark).count()
        except Exception as error:  # noqa: BLE001
            errors.append(str(error))

    from pyspark import InheritableThread

    thread = InheritableThread(target=run)
    thread.start()
    time.sleep(1.0)
    actions.cancel_group(spark, "slow-ones")
    thread.join(60)
    assert errors and "cancel" in errors[0].lower()
    assert isinstance(thread, threading.Thread)


def test_shared_values(spark):
    lookup = shared.broadcast(spark, {1: "a"})
    df = spark.createDataFrame([(1,), (2,)], "k int")

    def named(batches):
        for b in batches:
            yield b.assign(v=b["k"].map(lookup.value))

    assert sorted((tuple(r) for r in df.mapInPandas(named, "k int, v string").collect())) == [(1, "a"), (2, None)]
    lookup.unpersist()
    lookup.destroy()
    kinds = shared.accumulable_set(spark)
    df.foreachPartition(lambda rows: kinds.add({r[0] for r in rows}))
    assert kinds.value == {1, 2}
    watched, metrics = shared.observe(df, n=F.count(F.lit(1)))
    watched.collect()
    assert metrics.get == {"n": 2}


def test_foreach_batch(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.txt").write_text("x\ny\n")
    stream = sources.text_stream(spark, str(source))
    query = sinks.foreach_batch(
        stream, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "state")
    )
    assert query.awaitTermination(60)
    assert spark.read.parquet(str(out)).count() == 2
