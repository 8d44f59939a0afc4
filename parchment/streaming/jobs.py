"""Structured Streaming counterparts of the store and the queue.

The reference behaviours are polling loops; here they are streams with bounded state. Watermarks are an addition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import latest_corrections


def new_uploads(stream: DataFrame, within: str = "1 day") -> DataFrame:
    """The first upload of each content within the watermark. Needs ``created_at`` and ``content``."""
    rows = stream.withColumn("checksum", F.sha2("content", 256))
    return rows.withWatermark("created_at", within).dropDuplicatesWithinWatermark(["checksum"])


def event_counts(stream: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per window and key; closed windows are emitted once."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


LEASE_OUT = "job_id string, status string, changed_at double"


def lease_states(stream: DataFrame, lease_seconds: int = 300) -> DataFrame:
    """``job_id, status, at`` (seconds of event time) in; each change of a job's state out, expired leases as QUEUED.

    A job in LEASED or RUNNING whose next event is later than its lease went back to the queue in between; one that
    falls silent is released by the event-time timer.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            _, due = state.get
            out.append((key[0], "QUEUED", due))
            state.remove()
        else:
            events = pd.concat(list(batches)).sort_values(["at", "status"])
            held = state.getOption
            for at, status in zip(events["at"], events["status"], strict=True):
                if held is not None and held[1] <= at:
                    out.append((key[0], "QUEUED", held[1]))
                out.append((key[0], status, float(at)))
                held = (status, float(at) + lease_seconds) if status in ("LEASED", "RUNNING") else None
            if held is None:
                if state.exists:
                    state.remove()
            else:
                state.update(held)
                state.setTimeoutTimestamp(max(int(held[1] * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "status", "changed_at"])

    rows = stream.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", "0 seconds")
    return rows.groupBy("job_id").applyInPandasWithState(step, LEASE_OUT, "status string, due double", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run ``handle`` on each micro-batch: all that is there (``once``), or every two seconds."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="2 seconds").start()


def finished(stream: DataFrame, path: str) -> DataFrame:
    """What an append-only stream gives for all that is there now, as a table under ``path``.

    Output and progress stand in one folder, so a run that is cut off goes on where it was.
    """
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def fold_corrections(path: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that appends events once per batch id; read them back with ``current_corrections``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")  # the same batch writes the same folder again

    return handle


def current_corrections(spark, path: str) -> DataFrame:
    return latest_corrections(spark.read.parquet(path))
