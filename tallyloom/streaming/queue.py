"""The work queue as streams: a poll loop over new events, present states, and requeueing of stale claims."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import jobs

EVENTS = "job_id string, seq long, at timestamp, state string, stage string, claimed_by string, progress_done int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def poll(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = False, every: str = "2 seconds") -> StreamingQuery:
    """Applies ``work`` to the queued jobs of each micro-batch and adds what it returns. A micro-batch owns its jobs, so
    nothing is claimed twice; a batch that is run again overwrites its own part. ``once``: what there is, then the end."""

    def batch(df: DataFrame, batch_id: int) -> None:
        work(df.filter(F.col("state") == jobs.QUEUED)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def latest(stream: DataFrame) -> DataFrame:
    """Each job's present fields, in update mode."""
    return jobs.latest(stream)


class _Stale(StatefulProcessor):
    """Holds when a running job was last heard of, and its last event's number; a timer asks whether it still runs."""

    def __init__(self, seconds: int):
        self.millis = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "seq long, state string, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, state, due = self.state.get() if self.state.exists() else (0, "", 0)
        for df in rows:
            for r in df.sort_values("seq").itertuples():
                seq = max(seq, int(r.seq))
                state = r.state if isinstance(r.state, str) else state
        if due:
            self.handle.deleteTimer(due)
        due = 0
        if state == jobs.RUNNING:  # any event of a running job counts as a sign of life
            due = timerValues.getCurrentProcessingTimeInMs() + self.millis
            self.handle.registerTimer(due)
        self.state.update((seq, state, due))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, state, _ = self.state.get()
        self.state.update((seq + 1, jobs.QUEUED, 0))
        if state == jobs.RUNNING:
            yield pd.DataFrame({"job_id": [key[0]], "seq": [seq + 1], "state": [jobs.QUEUED]})

    def close(self) -> None:
        pass


def requeue_stale(stream: DataFrame, seconds: int = jobs.STALE_SECONDS) -> DataFrame:
    """An event that queues a job again when nothing was heard of its claimant for so long."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = stream.select(F.col("job_id").cast("string").alias("job_id"), "seq", "state").groupBy("job_id")
    return keyed.transformWithStateInPandas(_Stale(seconds), "job_id string, seq long, state string", "Append", "ProcessingTime")


class Progress(StreamingQueryListener):
    """Tells how far a poll loop is: after each micro-batch, ``tell`` gets its number and its count of rows. Telling is best
    effort: what it raises is counted and goes no further, so a lost ping never stops the work."""

    def __init__(self, tell: Callable[[int, int], None]):
        self.tell, self.failed = tell, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        try:
            self.tell(event.progress.batchId, event.progress.numInputRows)
        except Exception:  # noqa: BLE001
            self.failed += 1

    def onQueryTerminated(self, event) -> None:
        pass
