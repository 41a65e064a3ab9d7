"""Streams of the job queue against their batch twins, over several batches and across restarts."""

import json
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mezze.operators import jobs as batch
from mezze.plans.stream_queries import COLUMNS, replay
from mezze.plans.views import job_events
from mezze.session import ship
from mezze.sources.job_events import JobEventReader, JobEvents, Slice
from mezze.streaming import jobs, queue
from mezze.streaming.state import PROVIDER


@pytest.fixture(scope="module")
def session(spark):
    ship(spark)
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", "3")
    own.dataSource.register(JobEvents)
    return own


def wanted(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def run(stream, sink, state):
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).start()
    try:
        query.processAllAvailable()
        return [p["numInputRows"] for p in query.recentProgress]
    finally:
        query.stop()


def captured(spark, events, folder, cuts, disorder=0):
    """Files of the events in the order of time, `disorder` of them out of it; all but the last are renamed to be put back later."""
    rows = events.orderBy("ts", "event_id").collect()
    rnd = random.Random(1)
    for at in range(0, len(rows) - disorder, disorder or len(rows)):
        part = rows[at : at + disorder]
        rnd.shuffle(part)
        rows[at : at + disorder] = part
    end = [(-1, None, None, None, "end", max(r["ts"] for r in rows).replace(year=2030))]
    size = len(rows) // cuts + 1
    os.makedirs(folder)
    for k in range(cuts):
        part = [tuple(r) for r in rows[k * size : (k + 1) * size]] + (end if k == cuts - 1 else [])
        df = spark.createDataFrame(part, "event_id long, place_id long, host string, kind string, state string, ts timestamp").coalesce(1)
        df.write.parquet(f"{folder}/tmp{k}")
        (name,) = [n for n in os.listdir(f"{folder}/tmp{k}") if n.endswith(".parquet")]
        os.rename(f"{folder}/tmp{k}/{name}", f"{folder}/{k:04d}.parquet.later")


def arrive(folder, *files):
    for k in files:
        os.rename(f"{folder}/{k:04d}.parquet.later", f"{folder}/{k:04d}.parquet")


def stream(session, folder, progress, rows=400, by_task=150):
    return session.readStream.format("job_events").option("path", folder).option("progress", progress).option("maxRowsPerBatch", rows).option("maxRowsPerTask", by_task).load()


@pytest.fixture(scope="module")
def events(spark, sf_dir):
    own = job_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).select(*COLUMNS)
    # A place in trouble: failures by the second, a queueing right when a retry falls due, equal times, a null place and kind.
    odd = [(9001, 7777, "h", None, "failed", 0), (9002, 7777, "h", None, "failed", 1), (9003, 7777, "h", "enrich", "queued", 7), (9004, 7777, "h", "enrich", "failed", 7), (9005, 7777, "h", "enrich", "failed", 8),
           (9006, None, "g", "enrich", "failed", 8), (9007, None, "g", "enrich", "completed", 11), (9008, 7778, "h", "discover", "failed", 11), (9009, 7779, None, "enrich", "captcha_blocked", 600), (9010, 7779, None, "enrich", "failed", 607)]
    more = spark.createDataFrame(odd, "event_id long, place_id long, host string, kind string, state string, s long")
    return own.unionByName(more.select("event_id", "place_id", "host", "kind", "state", F.timestamp_seconds(F.lit(1704100000) + F.col("s")).alias("ts"))).cache()


def test_retries_fire_as_in_the_batch_and_after_a_restart(session, events, tmp_path):
    folder, sink, state, progress = (str(tmp_path / n) for n in ("in", "sink", "state", "progress"))
    captured(session, events, folder, 4, disorder=7)
    for files in ((0,), (1, 2), (3,)):
        arrive(folder, *files)
        run(jobs.retries(stream(session, folder, progress), "30 days"), sink, state)
    got = session.read.parquet(sink)
    failed = batch.retries(events).select(F.lit("failed").alias("what"), "event_id", "place_id", "attempt", "delay_s", "final", F.lit(None).cast("timestamp").alias("due_at"))
    due = batch.due(events).select(F.lit("retry").alias("what"), "event_id", "place_id", "attempt", F.lit(None).cast("long"), F.lit(False), "due_at")
    assert wanted(got) == wanted(failed.union(due))
    assert got.filter("what = 'retry'").count() > 100
    trouble = {(r["event_id"], r["what"]): r["attempt"] for r in got.filter("event_id > 9000").collect()}
    # 9002 would fall due at the very time of the queueing, which calls it off; the discovery is tried once.
    assert (9001, "retry") in trouble and (9002, "retry") not in trouble and (9008, "retry") not in trouble and trouble[9004, "failed"] == 1


def test_hosts_stay_static_as_in_the_batch_and_their_state_goes(session, events, tmp_path):
    folder, sink, state, progress = (str(tmp_path / n) for n in ("in", "sink", "state", "progress"))
    captured(session, events, folder, 3, disorder=5)
    for files in ((0, 1), (2,)):
        arrive(folder, *files)
        query = jobs.static_only(stream(session, folder, progress), 7200, "30 days").writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).start()
        query.processAllAvailable()
        last = query.lastProgress
        query.stop()
    assert wanted(session.read.parquet(sink).filter("event_id >= 0")) == wanted(batch.static_only(events, 7200))
    assert last["stateOperators"][0]["numRowsTotal"] < 20  # all hosts but for the mark of the end are forgotten


def test_late_events_are_left_out(session, tmp_path):
    folder, sink, state, progress = (str(tmp_path / n) for n in ("in", "sink", "state", "progress"))
    rows = [(1, 5, "h", "enrich", "failed", 1000), (2, 5, "h", "enrich", "failed", 5000), (9, 6, "h", "enrich", "processing", 5001), (3, 5, "h", "enrich", "failed", 1100)]
    os.makedirs(folder)
    for k, r in enumerate([*rows, (4, None, "z", "enrich", "end", 900_000)]):
        df = session.createDataFrame([r], "event_id long, place_id long, host string, kind string, state string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1)
        df.write.parquet(f"{folder}/t{k}")
        (name,) = [n for n in os.listdir(f"{folder}/t{k}") if n.endswith(".parquet")]
        os.rename(f"{folder}/t{k}/{name}", f"{folder}/{k}.parquet")
    run(jobs.retries(stream(session, folder, progress, rows=1), "10 minutes"), sink, state)
    assert {r["event_id"]: r["attempt"] for r in session.read.parquet(sink).filter("what = 'failed'").collect()} == {1: 1, 2: 2}


def test_consumer_reads_each_event_once_in_bounded_batches(session, events, tmp_path):
    folder, sink, state, progress = (str(tmp_path / n) for n in ("in", "sink", "state", "progress"))
    captured(session, events, folder, 5)
    sizes = []
    for files in ((0, 1), (), (2, 3, 4)):
        arrive(folder, *files)
        sizes += run(stream(session, folder, progress, rows=130, by_task=50), sink, state)
    assert wanted(session.read.parquet(sink).select(*COLUMNS).filter("event_id >= 0")) == wanted(events)
    assert 0 < max(sizes) <= 130 and sum(sizes) == events.count() + 1
    assert len(os.listdir(progress)) <= 3


def test_a_lost_plan_is_passed_over(tmp_path):
    import pyarrow as pa

    folder, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    os.makedirs(folder)
    pq.write_table(pa.table({"x": list(range(10))}), f"{folder}/a.parquet")
    reader = lambda: JobEventReader({"path": folder, "progress": progress, "maxrowsperbatch": "4", "maxrowspertask": "3"})
    first = reader()
    assert first.latestOffset() == {"file": "a.parquet", "row": 4} == reader().latestOffset()
    assert first.partitions(first.initialOffset(), first.latestOffset()) == [Slice(f"{folder}/a.parquet", 0, 3), Slice(f"{folder}/a.parquet", 3, 4)]
    assert reader().latestOffset() == {"file": "a.parquet", "row": 8}
    with open(f"{progress}/000000000001.json", "w") as f:
        f.write(json.dumps({"file": "a.parquet", "row": 8})[:-3])
    assert reader().latestOffset() == {"file": "a.parquet", "row": 8}
    assert first.partitions({"file": "a.parquet", "row": 10}, {"file": "a.parquet", "row": 10}) == []


def test_queue_takes_each_job_once(session, events, tmp_path):
    folder, path, state, progress = (str(tmp_path / n) for n in ("in", "queue", "state", "progress"))
    captured(session, events, folder, 4)
    arrive(folder, 0, 1, 2, 3)
    requests = lambda: stream(session, folder, progress).filter("state = 'queued'").select("kind", "place_id", (F.col("event_id") % 5 == 0).alias("force"), F.col("ts").alias("requested_at"))

    def fails(rows, number):
        queue.add(rows, number, path)
        if number == 1:
            raise RuntimeError("lost after the batch was written, before it was committed")

    query = requests().writeStream.foreachBatch(fails).option("checkpointLocation", state).start()
    with pytest.raises(Exception, match="lost after"):
        query.processAllAvailable()
    query.stop()
    query = queue.enqueue(requests(), path, state, processingTime="0 seconds")
    query.processAllAvailable()
    query.stop()
    got = queue.jobs_of(session, path)
    whole = queue.job_ids(events.filter("state = 'queued'").select("kind", "place_id", (F.col("event_id") % 5 == 0).alias("force"), F.col("ts").alias("requested_at")))
    assert wanted(got.select("job_id")) == wanted(whole.select("job_id").distinct())
    assert got.select("batch").distinct().count() > 2
    assert wanted(got.select("job_id", "requested_at")) == wanted(whole.groupBy("job_id").agg(F.min("requested_at")))


def test_replayed_files_are_in_the_order_of_time(spark, sf_dir):
    folder = replay(spark, sf_dir, files=3)
    names = sorted(n for n in os.listdir(folder) if n.endswith(".parquet"))
    times = [t for n in names for t in pq.read_table(f"{folder}/{n}", columns=["ts"])["ts"].to_pylist()]
    assert times == sorted(times) and len(times) == job_events(spark, sf_dir).count() + 1
