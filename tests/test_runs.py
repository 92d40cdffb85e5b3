"""State over a stream: a run that is stopped and resumed equals the batch form."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from voxframe.plans import trials
from voxframe.streaming import runs

SCHEMA = "run string, event_id long, ts timestamp, oom boolean"


def test_stopped_and_resumed_stream_equals_the_batch(spark, tmp_path):
    g = np.random.default_rng(4)
    began = datetime.datetime(2024, 1, 1)
    times = np.sort(g.integers(0, 4000, 120))
    rows = [(f"r{n % 3}", n, began + datetime.timedelta(seconds=int(t)), bool(g.random() < 0.1) if n % 11 else None) for n, t in enumerate(times)]
    end = [("zz", 1000, began + datetime.timedelta(days=2), False), ("zz", 1001, began + datetime.timedelta(days=4), False)]
    source, out, kept = (str(tmp_path / n) for n in ("source", "out", "kept"))
    stream = lambda: runs.run_states(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), 16, 300, 3600)
    for part in (rows[:30], rows[30:55], rows[55:], end[:1], end[1:]):  # each is read by a query of its own, which goes on from the last
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        runs.start(stream(), out, kept).awaitTermination(120)
    got = spark.read.parquet(out).filter("run <> 'zz'").collect()
    table = spark.createDataFrame(rows, SCHEMA)
    sizes = {r["event_id"]: r["batch_size"] for r in trials.batch_sizes(table.withColumn("oom", F.coalesce("oom", F.lit(False))), ["run"], ["ts", "event_id"], 16).collect()}
    assert {r["event_id"]: r["batch_size"] for r in got if r["event_id"] is not None} == sizes and len(got) == len(rows) + 3
    points = {(r["run"], r["ts"]) for r in trials.refresh_points(table.select("run", "ts"), ["run"], "ts", 300).collect()}
    assert {(r["run"], r["ts"]) for r in got if r["report"]} == points
