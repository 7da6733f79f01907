"""Running jobs: start, look at, cancel, recover, and what they measure."""

from __future__ import annotations

import bisect
import json
import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from weirflow.session import shared_path

STATES = ("CREATED", "RUNNING", "CANCELED", "FAILED", "FINISHED")
#: Bounds of the histograms of latencies and of checkpoints, in seconds.
LATENCY_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
CHECKPOINT_BOUNDS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


@contextmanager
def fitted(spark: SparkSession):
    """Shuffles, and so the state of streams that are started here, in no more partitions than the cluster has cores.

    Every partition of state costs each micro-batch, and their number is the query's
    for good.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), max(8, spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return its rows, written to the shared folder.

    Append mode writes files once each; complete and update mode keep the last
    batch's (complete) or all batches' (update) rows.
    """
    spark = df.sparkSession
    checkpoint = checkpoint or shared_path(spark, f"{name}-state")
    out = shared_path(spark, name)
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", out)
    else:
        writer = df.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite" if mode == "complete" else "append").parquet(out))
    with fitted(spark):
        query = writer.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@dataclass
class Job:
    name: str
    query: StreamingQuery | None
    checkpoint: str
    submitted: float = field(default_factory=time.time)
    canceled: bool = False

    @property
    def status(self) -> str:
        if self.query is None:
            return "CREATED"
        if self.query.isActive:
            return "RUNNING"
        if self.query.exception() is not None:
            return "FAILED"
        return "CANCELED" if self.canceled else "FINISHED"


class Jobs:
    """Jobs of this session by name. State, offsets and commits of each live in its checkpoint folder."""

    def __init__(self, spark: SparkSession, checkpoints: str | None = None):
        self.spark = spark
        self.checkpoints = (checkpoints or shared_path(spark, "jobs")).rstrip("/")
        self.jobs: dict[str, Job] = {}

    def submit(self, name: str, df: DataFrame, sink: str = "memory", mode: str = "append", interval_ms: int | None = None, checkpoint: str | None = None, **options) -> Job:
        """Start a stream. Without an interval it takes what is there and finishes."""
        if name in self.jobs and self.jobs[name].status == "RUNNING":
            raise ValueError(f"job {name!r} is running")
        place = checkpoint or f"{self.checkpoints}/{name}"
        writer = df.writeStream.format(sink).outputMode(mode).queryName(name).option("checkpointLocation", place).options(**options)
        writer = writer.trigger(processingTime=f"{interval_ms} milliseconds") if interval_ms else writer.trigger(availableNow=True)
        self.jobs[name] = Job(name, writer.start(), place)
        return self.jobs[name]

    def recover(self, name: str, df: DataFrame, **how) -> Job:
        """Start again from the last committed batch of the job's checkpoint."""
        return self.submit(name, df, checkpoint=self.jobs[name].checkpoint if name in self.jobs else None, **how)

    def list(self) -> list[dict]:
        return [self.describe(n) for n in sorted(self.jobs, key=lambda n: -self.jobs[n].submitted)]

    def describe(self, name: str) -> dict:
        job = self.jobs[name]
        return {"job": name, "status": job.status, "submitted": job.submitted, "checkpoint": job.checkpoint}

    def histogram(self) -> dict[str, int]:
        """How many jobs are in each state."""
        found = [j.status for j in self.jobs.values()]
        return {s: found.count(s) for s in STATES}

    def cancel(self, name: str, savepoint: str | None = None) -> dict:
        """Stop a job; with ``savepoint`` its checkpoint is copied there, to start another from."""
        job = self.jobs[name]
        job.canceled = job.query.isActive
        job.query.stop()
        if savepoint:
            self.savepoint(name, savepoint)
        return self.describe(name)

    def savepoint(self, name: str, to: str) -> str:
        """Copy a stopped job's checkpoint folder."""
        if self.jobs[name].status == "RUNNING":
            raise ValueError("a running job's checkpoint changes while it is copied; cancel it first")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        a, b = jvm.org.apache.hadoop.fs.Path(self.jobs[name].checkpoint), jvm.org.apache.hadoop.fs.Path(to)
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
        return to

    def checkpoints_of(self, name: str) -> list[int]:
        """Numbers of the batches that are committed, latest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.jobs[name].checkpoint}/commits")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def metrics(self, name: str) -> dict:
        """What the last batch measured: rows, rate, time, watermark and state."""
        return progress_metrics(self.jobs[name].query.lastProgress)


def progress_metrics(progress) -> dict:
    """Figures of one batch from its progress (a dict, or Spark's own object; None: nothing yet)."""
    p = {} if progress is None else progress if isinstance(progress, dict) else json.loads(progress.json)
    state, spent, times = p.get("stateOperators") or [], p.get("durationMs") or {}, p.get("eventTime") or {}
    moment = lambda name: datetime.fromisoformat(times[name].replace("Z", "+00:00"))
    lag = round((moment("max") - moment("watermark")).total_seconds() * 1000) if "max" in times and "watermark" in times else None
    return {
        "records": p.get("numInputRows", 0),
        "records_per_second": p.get("processedRowsPerSecond") or 0.0,
        "batch_ms": spent.get("triggerExecution", 0),
        "commit_ms": spent.get("walCommit", 0) + spent.get("commitOffsets", 0),
        "watermark": times.get("watermark"),
        "watermark_lag_ms": lag,
        "state_rows": sum(s.get("numRowsTotal", 0) for s in state),
        "state_bytes": sum(s.get("memoryUsedBytes", 0) for s in state),
        "late_rows": sum(s.get("numRowsDroppedByWatermark", 0) for s in state),
    }


class Meter(StreamingQueryListener):
    """Figures over all queries of a session; add with ``spark.streams.addListener``.

    Records and batches in all; the smoothed time of a batch; histograms of batches
    and of commits to the checkpoint; and of each query, as last told, the lag of its
    watermark behind the latest time seen, the bytes of its state and the late rows.
    """

    def __init__(self):
        self.records = 0
        self.batches = 0
        self.smoothed_ms = 0.0
        self.latencies = [0] * (len(LATENCY_BOUNDS) + 1)
        self.checkpoints = [0] * (len(CHECKPOINT_BOUNDS) + 1)
        self.watermark_lag_ms: dict[str, int] = {}
        self.state_bytes: dict[str, int] = {}
        self.late_rows: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.tell(json.loads(event.progress.json))

    def tell(self, progress: dict) -> None:
        got = progress_metrics(progress)
        name = progress.get("name") or progress.get("id", "")
        self.records += got["records"]
        self.batches += 1
        self.smoothed_ms = 0.1 * got["batch_ms"] + 0.9 * self.smoothed_ms
        self.latencies[bisect.bisect_left(LATENCY_BOUNDS, got["batch_ms"] / 1000)] += 1
        self.checkpoints[bisect.bisect_left(CHECKPOINT_BOUNDS, got["commit_ms"] / 1000)] += 1
        self.state_bytes[name] = got["state_bytes"]
        self.late_rows[name] = self.late_rows.get(name, 0) + got["late_rows"]
        if got["watermark_lag_ms"] is not None:
            self.watermark_lag_ms[name] = got["watermark_lag_ms"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
