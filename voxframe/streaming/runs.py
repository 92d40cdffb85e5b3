"""State of runs over a stream of trials: the batch size that an out-of-memory failure halves for good, and when a report is due."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: A number of runs that share a bucket are one group, so calls of Python don't grow with the runs. Fixed: a checkpoint is kept by bucket.
BUCKETS = 2048
#: Of the runs of a bucket, an array each.
STATE = "run array<string>, failures array<int>, began array<long>, span array<long>, last array<long>"
RESULT = "run string, event_id long, ts timestamp, batch_size int, report boolean"


def run_states(trials: DataFrame, first: int = 16, seconds: int = 60, idle: int = 3600, late: str = "0 seconds") -> DataFrame:
    """RESULT for each trial of a stream (run, event_id, ts, oom): the batch size it runs with, and whether the report is written after it.

    The size halves, down to 1, with each out-of-memory failure, and stays so for
    the run's later trials. A report is written after a run's first trial and after the
    first of each further span of `seconds` since it began; and once more, in a
    row without event_id, when `idle` seconds of event time have passed without a
    trial, where the run's state ends. Trials of a micro-batch are taken by time and
    id; those that come in a later one, after these. Four numbers a run are kept, by bucket, in
    the checkpoint, so a query that stops goes on where it was. A null oom is no failure.
    """

    def size(failures: int) -> int:
        return max(1, first >> min(failures, 30))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {run: own for run, *own in zip(*state.get, strict=True)} if state.exists else {}
        new = {}
        # Plain lists: pandas would take longer over the frames of a run than over its trials.
        for f in () if state.hasTimedOut else batches:
            for run, micros, event, oom in zip(f["run"].tolist(), f["micros"].tolist(), f["event_id"].tolist(), f["oom"].tolist(), strict=True):
                new.setdefault(run, []).append((int(micros), int(event), bool(oom)))
        out = []
        for run, trials in new.items():
            failures, began, span, last = kept.get(run, (0, None, -1, None))
            for micros, event, oom in sorted(trials):
                began = micros if began is None else began
                own = (micros - began) // (seconds * 1_000_000)
                out.append((run, event, micros, size(failures), own > span))
                span, failures, last = max(span, own), failures + oom, max(micros, micros if last is None else last)
            kept[run] = (failures, began, span, last)
        # Runs with trials in this micro-batch aren't idle in it; the others are once the watermark has passed.
        now, due = state.getCurrentWatermarkMs(), lambda own: own[3] // 1000 + idle * 1000
        for run in [r for r, own in kept.items() if r not in new and due(own) < now]:
            failures, _, _, last = kept.pop(run)
            out.append((run, None, last, size(failures), True))
        if kept:
            state.update((list(kept), *[[own[n] for own in kept.values()] for n in range(4)]))
            state.setTimeoutTimestamp(max(min(map(due, kept.values())), now + 1))
        elif state.exists:
            state.remove()
        if out:
            run, event, micros, sizes, report = zip(*out, strict=True)
            yield pd.DataFrame({"run": run, "event_id": pd.array(event, "Int64"), "ts": np.array(micros, "datetime64[us]"), "batch_size": sizes, "report": report})

    rows = trials.select(F.col("run").cast("string").alias("run"), "event_id", "ts", F.coalesce("oom", F.lit(False)).alias("oom"), F.unix_micros("ts").alias("micros"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(BUCKETS)))
    return rows.withWatermark("ts", late).groupBy("bucket").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start(states: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived, written once to a folder; goes on from the checkpoint when it is called again."""
    return states.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
