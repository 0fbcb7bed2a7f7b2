"""The life of jobs as streaming state: pending, running, and one end that later or late events never turn back."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Statuses in the order in which a job may pass through them; those after running are ends.
PENDING, RUNNING = "pending", "running"
ENDS = ("completed", "failed", "cancelled")
TIMED_OUT = "timed_out"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lifecycle(StatefulProcessor):
    """State of a bucket of jobs: of each its status, the time of its last event (microseconds) and whether it has ended, and when.

    Events older than the job's last one are ignored, and so are all that follow an end. A job that hears nothing for the time
    limit is timed out at that time, whether the watermark passes it or a later event comes in first. An ended job is kept
    for a while, for events that are late but not too late for the watermark, and then forgotten: so the state holds open jobs
    and those that ended lately. A bucket has one timer, for the job that is due first; it serves all that are due by then.
    """

    def __init__(self, limit_us: int, keep_us: int):
        self.limit, self.keep = limit_us, keep_us

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("jobs", "ids array<string>, statuses array<string>, lasts array<bigint>, ends array<bigint>, timer bigint")

    def _load(self) -> tuple[dict, int | None]:
        """Jobs (status, last, ended) by id, and the time of the bucket's timer."""
        got = self.state.get()
        if got is None:
            return {}, None
        ids, *rest, timer = tuple(got)
        return dict(zip(ids, zip(*rest, strict=True), strict=True)), timer

    def _due(self, last: int, ended: int | None) -> int:
        return (last + self.limit if ended is None else ended + self.keep) // 1000 + 1

    def _store(self, jobs: dict, timer: int | None) -> None:
        first = min((self._due(last, ended) for _, last, ended in jobs.values()), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if not jobs:
            self.state.clear()
            return
        self.state.update((list(jobs), *map(list, zip(*jobs.values(), strict=True)), first))

    def _row(self, job: str, status: str, last: int, ended: int | None) -> Row:
        return Row(job_id=job, status=status, last_us=last, ended_us=ended)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        jobs, timer = self._load()
        seen = {}
        for job, at, _, new in sorted((r.job_id, r.at_us, r.event_id, r.status) for r in rows):
            seen[job] = None
            status, last, ended = jobs.get(job, (None, None, None))
            if ended is not None or last is not None and at < last:
                continue
            if last is not None and at - last > self.limit:
                jobs[job] = TIMED_OUT, last, last + self.limit
                continue
            if new in ENDS:
                status, ended = new, at
            elif status is None or new == RUNNING:
                status = new
            jobs[job] = status, at, ended
        self._store(jobs, timer)
        for job in seen:
            yield self._row(job, *jobs[job])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        jobs, _ = self._load()
        at, mark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        out = []
        for job, (_, last, ended) in list(jobs.items()):
            due = self._due(last, ended)
            if due > at and due >= mark:
                continue
            if ended is not None:
                del jobs[job]
                continue
            jobs[job] = TIMED_OUT, last, last + self.limit
            out.append(self._row(job, *jobs[job]))
        self._store(jobs, None)  # the timer that has expired is deleted already
        yield from out

    def close(self) -> None:
        pass


def lifecycles(events: DataFrame, limit: str, keep: str, late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """Streaming, update mode: job_id, status, last_us, ended_us of the jobs that a batch or the watermark changed.

    events: job_id (string), ts, event_id, status. The session's state store must be RocksDB (use_rocksdb). Jobs share state by
    buckets, so that a batch costs a call of the store for a bucket rather than for each job; a batch rewrites the buckets that it
    touches. For more than some million open jobs take more buckets; their number is fixed for the life of a checkpoint.
    """
    micros = lambda s: int(events.sparkSession.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {s})").first()[0])
    e = events.withWatermark("ts", late).select(F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"), "job_id", "ts", "event_id", "status", F.unix_micros("ts").alias("at_us"))
    return e.groupBy("bucket").transformWithState(Lifecycle(micros(limit), micros(keep)), "job_id string, status string, last_us bigint, ended_us bigint", "Update", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB, on disk rather than in the executors' heaps."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
