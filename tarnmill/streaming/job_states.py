"""States of generation jobs kept from a stream of chunk events.

A chunk's state is its last event by (ts, event_id), whatever order events arrive in. Both that and the first event that is
more than queued are maxima and minima, so without `patience` Spark's own streaming aggregation by job and chunk keeps them: a
job with a third of all events spans many tasks, and a batch writes the chunks that it has events of. Timers need a state
machine: with `patience`, a job's chunks are dealt into shards by number; each shard keeps its chunks in a state map, of which a
batch reads and writes only those that it has events of, and its counts beside it. Chunks or shards are added up where states
are read. A folder goes on as it began, with patience or without.

started_at is the first event that is more than queued and stays; finished_at is there while no chunk is left. With
`patience`, a chunk that runs without an event for so long, by event time, becomes an error; a later event takes that back.
Events with a null job, chunk, time or id are left out, as are those whose status is unknown; an empty message is none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from tarnmill.operators import jobs, relational, staging

STATUSES = ("queued", "running", "done", "error")
TIMED_OUT = "timed out"
SHARD = "job_id long, shard int, total long, done long, error long, error_chunk long, last_error string, started long, last long"
CHUNK = "job_id long, chunk_no long, event struct<ts: long, event_id: long, status: string, message: string>, started long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ShardStates(StatefulProcessor):
    """Chunks by number as (ts, event_id, status, message), counts of the shard; instants are microseconds."""

    def __init__(self, patience: int | None = None):
        self.patience = patience

    def init(self, handle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "chunk_no long", "ts long, event_id long, status string, message string")
        self.failed = handle.getMapState("failed", "chunk_no long", "message string")
        self.counts = handle.getValueState("counts", "total long, done long, error long, error_chunk long, last_error string, started long, last long")

    def fold(self, key: tuple, events: pd.DataFrame, again: bool = False) -> pd.DataFrame:
        """Takes the last event of each chunk into the state; returns the shard's row. With `again`, one as late as the state's counts too."""
        total, done, error, error_chunk, last_error, started, last = self.counts.get() if self.counts.exists() else (0, 0, 0, None, None, None, None)
        lowest = events.loc[events.status != "queued", "ts"].min()
        started = min((int(x) for x in (started, lowest) if not pd.isna(x)), default=None)
        stale = False
        for e in events.sort_values(["ts", "event_id"]).drop_duplicates("chunk_no", keep="last").itertuples():
            at, message = (int(e.chunk_no),), None if pd.isna(e.message) or not e.message else e.message
            old = self.chunks.getValue(at) if self.chunks.containsKey(at) else None
            if old is not None and not again and (old[0], old[1]) >= (e.ts, e.event_id):
                continue
            before = old[2] if old else None
            total, done, error = total + (old is None), done + (e.status == "done") - (before == "done"), error + (e.status == "error") - (before == "error")
            self.chunks.updateValue(at, (int(e.ts), int(e.event_id), e.status, message))
            last = max(last or e.ts, e.ts)
            if e.status == "error":
                self.failed.updateValue(at, (message or "",))
                if error_chunk is None or at[0] >= error_chunk:
                    error_chunk, last_error = at[0], message
            elif before == "error":
                self.failed.removeKey(at)
                stale = stale or at[0] == error_chunk
            if self.patience is not None and e.status == "running":
                self.handle.registerTimer((int(e.ts) + self.patience) // 1000)
        if stale:  # the last failed chunk recovered: the highest of those that are left
            error_chunk, last_error = None, None
            for (n,) in self.failed.keys():
                error_chunk = n if error_chunk is None else max(error_chunk, n)
            if error_chunk is not None:
                last_error = self.failed.getValue((error_chunk,))[0] or None
        counts = (int(total), int(done), int(error), error_chunk, last_error, started, None if last is None else int(last))
        self.counts.update(counts)
        return pd.DataFrame([(*key, *counts)], columns=[c.split()[0] for c in SHARD.split(", ")]).astype({"error_chunk": "Int64", "started": "Int64", "last": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = None
        for events in rows:
            found = self.fold(key, events)
        if found is not None:
            yield found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Fails the chunks that still run and whose time is up."""
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        late = [(n, s) for (n,), s in self.chunks.iterator() if s[2] == "running" and (s[0] + self.patience) // 1000 * 1000 <= now]
        if late:
            # Under the instant and number of the last event, so that any later one wins.
            yield self.fold(key, pd.DataFrame([(n, s[0], s[1], "error", TIMED_OUT) for n, s in late], columns=["chunk_no", "ts", "event_id", "status", "message"]), again=True)

    def close(self) -> None:
        pass


def usable(events: DataFrame) -> DataFrame:
    """Events that count, with `at`, their instant."""
    return events.filter(F.col("status").isin(*STATUSES)).dropna(subset=["job_id", "chunk_no", "event_id", "ts"]).withColumn("at", F.col("ts").cast("timestamp"))


def chunk_states(events: DataFrame) -> DataFrame:
    """A stream of chunk rows (CHUNK) of the stream events(job_id, chunk_no, event_id, ts, status, message), one whenever a chunk has events."""
    at, long = F.unix_micros("at"), lambda c: F.col(c).cast("long").alias(c)
    last = F.max(F.struct(at.alias("ts"), long("event_id"), F.col("status"), F.when(F.col("message") != "", F.col("message")).alias("message")))
    return usable(events).groupBy(long("job_id"), long("chunk_no")).agg(last.alias("event"), F.min(F.when(F.col("status") != "queued", at)).alias("started"))


def shard_states(events: DataFrame, shards: int = 16, patience: str | None = None, late: str = "0 seconds") -> DataFrame:
    """A stream of shard rows of the stream events(job_id, chunk_no, event_id, ts, status, message), one whenever a shard changes."""
    stated = usable(events)
    stated = stated.withWatermark("at", late) if patience else stated
    keyed = stated.select("job_id", F.pmod("chunk_no", F.lit(shards)).cast("int").alias("shard"), "chunk_no", "event_id", F.unix_micros("at").alias("ts"), "status", "message", *(["at"] if patience else []))
    micros = int(pd.Timedelta(patience).total_seconds() * 1_000_000) if patience else None
    return keyed.groupBy("job_id", "shard").transformWithStateInPandas(ShardStates(micros), SHARD, "Update", "EventTime" if patience else "None")


def counted(chunks: DataFrame) -> DataFrame:
    """The chunk rows of all batches as one row a job, as of one shard. A later row of a chunk is never below an earlier one, so no order of batches is needed."""
    each = chunks.groupBy("job_id", "chunk_no").agg(F.max("event").alias("event"), F.min("started").alias("started"))
    is_ = lambda status: F.col("event.status") == status
    worst = F.max(F.when(is_("error"), F.struct("chunk_no", "event.message")))
    return each.groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(is_("done")).alias("done"), F.count_if(is_("error")).alias("error"), worst["chunk_no"].alias("error_chunk"), worst["message"].alias("last_error"), F.min("started").alias("started"), F.max("event.ts").alias("last"))


def job_states(shards: DataFrame) -> DataFrame:
    """One row a job of its shards' rows."""
    worst = F.when(F.col("error_chunk").isNotNull(), F.struct("error_chunk", "last_error"))
    sums = shards.groupBy("job_id").agg(F.sum("total").alias("total_chunks"), F.sum("done").alias("done_chunks"), F.sum("error").alias("error_chunks"), F.max(worst)["last_error"].alias("last_error"), F.min("started").alias("started"), F.max("last").alias("last"))
    status = jobs.derive_status(F.col("total_chunks"), F.col("done_chunks"), F.col("error_chunks"))
    over = F.col("total_chunks") == F.col("done_chunks") + F.col("error_chunks")
    stated = sums.withColumn("status", status).withColumns({"phase": jobs.derive_phase(F.col("status")), "started_at": F.timestamp_micros("started"), "finished_at": F.when(over, F.timestamp_micros("last"))})
    return stated.drop("started", "last")


def follow(spark: SparkSession, path: str, schema: StructType, prepare=lambda events: events, folder: str | None = None, shards: int = 16, patience: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """Takes the event files at `path` that were not read before into the states, and returns the jobs as they stand.

    `prepare` makes events of the files' rows. With the `folder` of an earlier call the states go on from there. A batch
    writes its rows under its number, so one that runs again after a failure replaces its own.
    """
    folder = folder or f"{staging.stage_dir(spark)}/jobs-{uuid.uuid4().hex}"

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/updates/batch={batch}")

    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        events = prepare(reader.parquet(path))
        rows = shard_states(events, shards, patience) if patience else chunk_states(events)
        run = rows.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    kind = StructType.fromDDL(SHARD if patience else CHUNK).add("batch", "long")
    updates = spark.read.schema(kind).parquet(f"{folder}/updates") if staging.exists(spark, f"{folder}/updates") else spark.createDataFrame([], kind)
    if not patience:
        return job_states(counted(updates))
    # A batch may hold two rows of a shard, of its events and of a timer; the one that counts more failures is the later.
    last = relational.newest(updates, ["job_id", "shard"], [-F.col("batch"), -F.coalesce("error", F.lit(0))])
    return job_states(last.drop("batch", "shard"))
