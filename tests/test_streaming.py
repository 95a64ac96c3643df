from __future__ import annotations

import random
import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.schema import FILE_EVENT
from quarry.scratch import recorded
from quarry.streaming.refresh import Debounce, bursts, streamed_bursts, watch_tree


def test_gap_of_five_seconds_starts_a_burst(spark):
    t = datetime(2024, 1, 1)
    at = [0, 4.999, 9.998, 14.998, 30]
    df = spark.createDataFrame([("p", t + timedelta(seconds=s)) for s in at], "project string, ts timestamp")
    got = sorted(r["n_events"] for r in bursts(df, ["project"]).collect())
    assert got == [1, 1, 3]


@pytest.mark.parametrize("rows", [1, 7, 60])
def test_bursts_of_one_key_spread_over_tasks(spark, rows):
    rng = random.Random(rows)
    t = datetime(2024, 1, 1)
    seen = [(key, t + timedelta(seconds=rng.choice([0, 0, 4.999999, 5, 5, 2]) + 5 * rng.randrange(120))) for key in ("p", "p", "q", None) for _ in range(60)]
    seen += [("r", t + timedelta(seconds=4 * k)) for k in range(80)] + [("p", None)]
    df = spark.createDataFrame(seen, "project string, ts timestamp")
    got = bursts(df, ["project"], rows=rows)
    want = []
    for key in ("p", "q", "r", None):
        for at in sorted(x for k, x in seen if k == key and x):
            if want and want[-1][0] == key and at - want[-1][2] < timedelta(seconds=5):
                want[-1] = (key, want[-1][1], at, want[-1][3] + 1)
            else:
                want.append((key, at, at, 1))
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_no_task_reads_all_events_of_a_key(spark):
    t = datetime(2024, 1, 1)
    df = spark.range(4000).select(F.lit("p").alias("project"), (F.lit(t) + F.make_dt_interval(secs=F.col("id") * 7)).alias("ts"))
    with recorded() as paths:
        got = bursts(df, ["project"], rows=500)
    assert got.count() == 4000 and len(paths) == 1
    sizes = [r["count"] for r in spark.read.parquet(paths[0]).groupBy("__part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_streamed_bursts(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a", "write", t), ("a", "chmod", t + timedelta(seconds=3)), ("b", "create", t + timedelta(seconds=4)), ("c", "remove", t + timedelta(seconds=60))]
    spark.createDataFrame(rows, FILE_EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(FILE_EVENT).parquet(str(tmp_path / "in")).withColumn("project", F.lit("p"))
    q = streamed_bursts(stream, ["project"]).writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert [r["n_events"] for r in spark.table("bursts").collect()] == [2]
    finally:
        q.stop()


def test_debounce_waits_for_quiet():
    runs = []
    debounce = Debounce(lambda: runs.append(time.time()), timedelta(seconds=0.6))
    began = time.time()
    for _ in range(5):
        debounce()
        time.sleep(0.2)
    last = time.time() - 0.2
    time.sleep(1.2)
    assert len(runs) == 1 and runs[0] - last >= 0.55 and runs[0] - began > 1.3
    debounce()
    debounce.stop()
    debounce()
    time.sleep(0.9)
    assert len(runs) == 1


def test_debounce_outlives_errors():
    runs = []

    def broken():
        runs.append(1)
        raise ValueError("broken")

    debounce = Debounce(broken, timedelta(seconds=0.05))
    for n in (1, 2):
        debounce()
        time.sleep(0.4)
        assert len(runs) == n
    debounce.stop()


def test_tree_events_drive_one_refresh(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text("x")
    done = []
    watch = watch_tree(spark, str(root), lambda: done.append(1), timedelta(seconds=4))
    try:
        time.sleep(6)
        for name in ("b.py", "c.py", "new/d.py"):
            (root / name).parent.mkdir(exist_ok=True)
            (root / name).write_text("y")
            time.sleep(1)
        until = time.time() + 40
        while not done and time.time() < until:
            time.sleep(0.5)
        time.sleep(2)
        assert done == [1]
    finally:
        watch.stop()
    assert not watch.query.isActive
