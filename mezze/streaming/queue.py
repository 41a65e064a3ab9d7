"""The queue as a sink: requests of a stream become jobs, each once, however often a batch is run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mezze.operators.jobs import DISCOVER

JOB = "job_id string, kind string, place_id string, requested_at timestamp"


def job_ids(requests: DataFrame) -> DataFrame:
    """The columns of JOB for requests (kind, place_id, force, requested_at).

    A place has one enrichment job, named by its id in the queue's alphabet. A forced request and a discovery get a name
    of their own from their time, and a discovery one of its content, so that a replay names them alike. Requests without
    a place_id ask for no enrichment.
    """
    millis = F.unix_millis(F.col("requested_at").cast("timestamp")).cast("string")
    safe = F.regexp_replace(F.col("place_id").cast("string"), "[^A-Za-z0-9_-]", "_")
    name = F.when(F.col("kind") == DISCOVER, F.concat_ws("-", F.lit("discover"), millis, F.lower(F.hex(F.xxhash64(F.col("place_id").cast("string"), "requested_at"))))).when(F.col("force"), F.concat_ws("-", safe, millis)).otherwise(safe)
    named = requests.select(name.alias("job_id"), F.coalesce("kind", F.lit("enrich")).alias("kind"), F.col("place_id").cast("string").alias("place_id"), F.col("requested_at").cast("timestamp").alias("requested_at"))
    return named.filter((F.col("kind") == DISCOVER) | F.col("place_id").isNotNull())


def jobs_of(spark: SparkSession, path: str) -> DataFrame:
    """The jobs that were added to the queue at `path`, and the number of the batch."""
    return spark.read.schema(f"{JOB}, batch long").parquet(path)


def add(batch: DataFrame, number: int, path: str) -> None:
    """Adds a batch's jobs that no earlier batch has: one Parquet folder for each batch.

    Run again, a batch meets the same earlier ones and writes its own folder anew, so it adds nothing.
    """
    spark = batch.sparkSession
    fresh = job_ids(batch).groupBy("job_id").agg(F.min_by(F.struct("kind", "place_id", "requested_at"), F.struct("requested_at", "kind", "place_id")).alias("job")).select("job_id", "job.*")
    if number > 0:
        fresh = fresh.join(jobs_of(spark, path).filter(F.col("batch") < number).select("job_id"), "job_id", "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")


def enqueue(requests: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query that adds the jobs of a stream of requests to the queue at `path`."""
    return requests.writeStream.foreachBatch(lambda batch, number: add(batch, number, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
