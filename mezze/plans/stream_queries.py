"""The job queue as streams over the events, replayed from files until they have taken all; their results are those of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mezze.plans.pipeline_queries import DUE, JOBS_SQL, RETRIES
from mezze.plans.views import job_events
from mezze.session import scratch
from mezze.sources.job_events import JobEvents
from mezze.streaming import jobs, queue
from mezze.streaming.state import PROVIDER

COLUMNS = ("event_id", "place_id", "host", "kind", "state", "ts")


#: Rows of a file at most: a task reads its file's row group for the rows that it takes of it.
FILE_ROWS = 100_000
#: Files of a range of time, about: a task sorts and writes one range, however many events there are.
RANGE_FILES = 10


def replay(spark: SparkSession, sf_dir: str, files: int = 8) -> str:
    """A folder with the events as files in the order of time, the last with an event so late that all others are past.

    There are `files` ranges of time, each a file or more, and more of them where they would be long.
    """
    events = job_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).select(*COLUMNS)
    none = {c: F.lit(None).cast(t) for c, t in events.dtypes}
    end = events.agg(F.max("ts").alias("last")).select(*[{"event_id": F.lit(-1).cast("long"), "state": F.lit("end"), "ts": (F.col("last") + F.make_dt_interval(days=F.lit(30)))}.get(c, none[c]).alias(c) for c in COLUMNS]).filter("ts IS NOT NULL")
    folder = scratch(spark, "job-events")
    ranges = max(files, -(-events.count() // (RANGE_FILES * FILE_ROWS)))
    events.unionByName(end).repartitionByRange(ranges, "ts").sortWithinPartitions("ts", "event_id").write.option("maxRecordsPerFile", FILE_ROWS).parquet(folder)
    return folder


def consume(spark: SparkSession, folder: str, rows_at_a_time: int) -> DataFrame:
    """The stream of the captured events in a folder, in a session of its own, which has the state store that timers need."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # Each partition opens and commits a state store in every batch, so there are as many as run at once.
    session.conf.set("spark.sql.shuffle.partitions", max(8, spark.sparkContext.defaultParallelism))
    session.dataSource.register(JobEvents)
    return session.readStream.format("job_events").option("path", folder).option("progress", scratch(session, "progress")).option("maxRowsPerBatch", rows_at_a_time).load()


def streamed(spark: SparkSession, sf_dir: str, step, rows_at_a_time: int = 1 << 20) -> DataFrame:
    """What `step` makes of the replayed events, from its sink."""
    folder, sink = replay(spark, sf_dir), scratch(spark, "stream-sink")
    out = step(consume(spark, folder, rows_at_a_time))
    query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch(spark, "stream-state")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(out.schema).parquet(sink)


def _consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = streamed(spark, sf_dir, lambda e: e).filter("event_id >= 0")
    return events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*COLUMNS)


def _queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the events that queue a place, every seventh by force."""
    folder, path = replay(spark, sf_dir), scratch(spark, "queue")
    requests = consume(spark, folder, 1 << 20).filter("state = 'queued'").select("kind", "place_id", (F.col("event_id") % 7 == 0).alias("force"), F.col("ts").alias("requested_at"))
    query = queue.enqueue(requests, path, scratch(spark, "queue-state"), processingTime="0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    jobs_ = queue.jobs_of(spark, path)
    return jobs_.select(F.when(F.col("kind") == "discover", F.substring_index("job_id", "-", 2)).otherwise(F.col("job_id")).alias("job_id"), "kind", "place_id", "requested_at")


QUERIES = {
    "stream_retry": (
        lambda s, d: streamed(s, d, jobs.retries),
        f"""{RETRIES} SELECT 'failed' AS what, event_id, place_id, attempt, delay_s, final, CAST(NULL AS TIMESTAMP) AS due_at FROM w
UNION ALL SELECT 'retry', event_id, place_id, attempt, NULL, false, due_at FROM w WHERE {DUE}""",
    ),
    "stream_host_ttl": (
        lambda s, d: streamed(s, d, lambda e: jobs.static_only(e, 36_000)).filter("event_id >= 0"),
        f"{JOBS_SQL} SELECT event_id, count(*) FILTER (state IN ('failed', 'captcha_blocked')) OVER (PARTITION BY host ORDER BY epoch_us(ts) RANGE BETWEEN 36000000000 PRECEDING AND 1 PRECEDING) > 0 AS static FROM jobs",
    ),
    "stream_consumer": (_consumed, f"{JOBS_SQL} SELECT event_id, place_id, host, kind, state, ts FROM jobs"),
    "stream_enqueue": (
        _queued,
        f"""{JOBS_SQL}, q AS (
  SELECT kind, CAST(place_id AS VARCHAR) AS place_id, ts AS requested_at,
    CASE WHEN kind = 'discover' THEN 'discover-' || epoch_us(ts) // 1000 WHEN event_id % 7 = 0 THEN place_id || '-' || epoch_us(ts) // 1000 ELSE CAST(place_id AS VARCHAR) END AS job_id
  FROM jobs WHERE state = 'queued'
) SELECT job_id, any_value(kind) AS kind, min_by(place_id, requested_at) AS place_id, min(requested_at) AS requested_at FROM q GROUP BY job_id, CASE WHEN kind = 'discover' THEN place_id END""",
    ),
}
