"""Streamed job states against a plain walk over the same events."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from tarnmill.streaming import job_states

EVENTS = "job_id long, chunk_no long, event_id long, ts timestamp, status string, message string"
START = datetime(2025, 1, 1, tzinfo=UTC)


def at(minutes):
    return START + timedelta(minutes=minutes)


def some_events(n, seed=5):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(9), i, at(rng.randrange(200)), rng.choice(job_states.STATUSES), rng.choice(["m", None, "", f"e{i}"])) for i in range(n)]
    return [*rows, (None, 1, 900, at(1), "done", "x"), (1, None, 901, at(1), "done", "x"), (1, 1, 902, None, "done", "x"), (1, 1, 903, at(999), "odd", "x"), rows[0]]


def plain(events):
    out = {}
    for job in {e[0] for e in events if e[0] is not None}:
        mine = [e for e in events if e[0] == job and None not in e[1:4] and e[4] in job_states.STATUSES]
        last = {}
        for e in sorted(mine, key=lambda e: (e[3], e[2])):
            last[e[1]] = e
        failed = {c: e[5] or None for c, e in last.items() if e[4] == "error"}
        done, began = sum(e[4] == "done" for e in last.values()), [e[3] for e in mine if e[4] != "queued"]
        over = len(last) == done + len(failed)
        out[job] = (len(last), done, len(failed), failed[max(failed)] if failed else None, min(began) if began else None, max(e[3] for e in last.values()) if over else None)
    return out


def write(spark, rows, folder):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def states(spark, folder, state, **more):
    found = job_states.follow(spark, folder, spark.createDataFrame([], EVENTS).schema, folder=state, shards=4, **more)
    stamp = lambda x: x.astimezone(UTC) if x else None
    return {r.job_id: (r.total_chunks, r.done_chunks, r.error_chunks, r.last_error, stamp(r.started_at), stamp(r.finished_at)) for r in found.collect()}


def test_states_go_on_after_a_restart(spark, tmp_path):
    """Three stops, events out of order across files, repeated rows, recovered failures."""
    rows, files, state = some_events(120), str(tmp_path / "in"), str(tmp_path / "state")
    for k in range(3):
        write(spark, rows[k::3], files)
        assert states(spark, files, state) == plain([e for j in range(k + 1) for e in rows[j::3]])
    assert states(spark, files, state) == plain(rows)


def test_a_failed_chunk_that_recovers_gives_way_to_the_next(spark, tmp_path):
    files, state = str(tmp_path / "in"), str(tmp_path / "state")
    write(spark, [(1, 0, 1, at(0), "error", "first"), (1, 8, 2, at(1), "error", "second"), (1, 4, 3, at(1), "done", None)], files)
    assert states(spark, files, state)[1] == (3, 1, 2, "second", at(0), at(1))
    write(spark, [(1, 8, 4, at(5), "running", None)], files)
    assert states(spark, files, state)[1] == (3, 1, 1, "first", at(0), None)
    write(spark, [(1, 8, 5, at(6), "done", None), (1, 0, 6, at(6), "done", None)], files)
    assert states(spark, files, state)[1] == (3, 3, 0, None, at(0), at(6))


def test_chunks_without_events_time_out(spark, tmp_path):
    files, state, more = str(tmp_path / "in"), str(tmp_path / "state"), {"patience": "30 minutes"}
    write(spark, [(1, 0, 1, at(0), "running", None), (1, 1, 2, at(0), "queued", None), (1, 2, 3, at(20), "running", None)], files)
    assert states(spark, files, state, **more)[1][:4] == (3, 0, 0, None)
    write(spark, [(2, 0, 4, at(40), "running", None)], files)  # moves the watermark past the first chunk's time only
    assert states(spark, files, state, **more)[1][:4] == (3, 0, 1, job_states.TIMED_OUT)
    write(spark, [(1, 0, 5, at(45), "done", None)], files)
    assert states(spark, files, state, **more)[1][:4] == (3, 1, 0, None)


def test_no_events(spark, tmp_path):
    files, state = str(tmp_path / "in"), str(tmp_path / "state")
    write(spark, [], files)
    assert states(spark, files, state) == {}


def test_without_timers_no_python_keeps_the_states(spark, tmp_path):
    """A call into Python for every job and shard cost milliseconds a key; the aggregation is Spark's own."""
    files, where = str(tmp_path / "in"), str(tmp_path / "state")
    write(spark, some_events(40), files)
    states(spark, files, where)
    operators = [op.operatorName for p in job_states_progress(spark, files, tmp_path) for op in p.stateOperators]
    assert operators and all(name == "stateStoreSave" for name in operators)


def job_states_progress(spark, files, tmp_path):
    stream = job_states.chunk_states(spark.readStream.schema(spark.createDataFrame([], EVENTS).schema).parquet(files))
    run = stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", str(tmp_path / "other")).trigger(availableNow=True).start()
    run.awaitTermination()
    return run.recentProgress
