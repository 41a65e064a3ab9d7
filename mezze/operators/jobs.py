"""Jobs of the enrichment queue, as batches over their events (event_id, place_id, host, kind, state, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STICKY = "captcha_blocked"
#: A kind of job that is tried once: a browser session, not a call that can be repeated.
DISCOVER = "discover"
ATTEMPTS = 3
FIRST_DELAY_S = 3


def dedup(events: DataFrame) -> DataFrame:
    """The first queued event of each place: a job that is known is not queued again."""
    queued = events.filter("state = 'queued'")
    return queued.groupBy("place_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min("ts").alias("ts"))


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("state").agg(F.count("*").alias("n"))


def rate_windows(events: DataFrame, seconds: int = 60, most: int = 15) -> DataFrame:
    """start, n, over: events in each window, and how many beyond what a worker may start."""
    w = events.groupBy(F.window("ts", f"{seconds} seconds")).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), "n", F.greatest(F.lit(0), F.col("n") - most).alias("over"))


def status(events: DataFrame) -> DataFrame:
    """place_id, status: the last state of each place; a wall against robots stays when nothing but failures follow it."""
    at = F.struct("ts", "event_id")
    last = events.groupBy("place_id").agg(F.max_by("state", at).alias("last"), F.max_by("state", F.when(F.col("state") != "failed", at)).alias("before"))
    return last.select("place_id", F.when((F.col("last") == "failed") & (F.col("before") == STICKY), STICKY).otherwise(F.col("last")).alias("status"))


def _failures(events: DataFrame) -> DataFrame:
    """The failures that count, each with its attempt, whether it is final, and when its place was next queued or completed."""
    order = Window.partitionBy("place_id").orderBy("ts", "event_id")
    anew = F.col("state").isin("queued", "completed")
    run = F.count(F.when(anew, 1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    next_ = F.first(F.when(anew, F.col("ts")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    failed = events.withColumn("run", run).withColumn("anew_at", next_).filter(F.col("state").isin("failed", STICKY))
    nth = F.row_number().over(Window.partitionBy("place_id", "run").orderBy("ts", "event_id"))
    most = F.when(F.col("kind") == DISCOVER, 1).otherwise(ATTEMPTS)
    final = (F.col("state") == STICKY) | (F.col("attempt") >= most)
    delay = F.when(~F.col("final"), FIRST_DELAY_S * F.pow(F.lit(2), F.col("attempt") - 1)).cast("long")
    return failed.withColumn("attempt", nth).filter(F.col("attempt") <= most).withColumn("final", final).withColumn("delay_s", delay)


def retries(events: DataFrame) -> DataFrame:
    """event_id, place_id, attempt, delay_s, final: failures of a place since it was last queued, and when the next try is due.

    Delays double from three seconds; the third failure is final, that of a discovery and a wall against robots at once.
    """
    return _failures(events).select("event_id", "place_id", "attempt", "delay_s", "final")


def due(events: DataFrame) -> DataFrame:
    """event_id, place_id, attempt, due_at: the retries that fall due before their place is queued or completed anew."""
    at = F.col("ts") + F.make_dt_interval(secs=F.col("delay_s"))
    waiting = _failures(events).filter("delay_s IS NOT NULL").withColumn("due_at", at)
    return waiting.filter("anew_at IS NULL OR anew_at > due_at").select("event_id", "place_id", "attempt", "due_at")


#: Rows of a task that looks for distinct places, so that its memory does not grow with the table.
FAN_ROWS = 500_000


def fan_out(requests: DataFrame, places: DataFrame) -> DataFrame:
    """job_id, request_id, google_place_id: one enrichment job for each place found by a discovery request.

    Repeats go before the join, on the two columns that tell them, dealt by request to as many tasks as `FAN_ROWS` asks:
    `places` is counted here. A job's id follows from its place.
    """
    clean = F.regexp_replace("google_place_id", "[^A-Za-z0-9_-]", "_")
    tasks = max(places.sparkSession.sparkContext.defaultParallelism, -(-places.count() // FAN_ROWS))
    found = places.select("request_id", "google_place_id").repartition(tasks, "request_id").distinct()
    return found.join(requests.select("request_id"), "request_id", "left_semi").select(clean.alias("job_id"), "request_id", "google_place_id")


def retained(events: DataFrame, completed_s: int = 3600, failed_s: int = 86400, most: int = 500) -> DataFrame:
    """event_id, state of finished jobs that are still kept at the time of the last event: by age, and the newest `most`."""
    now = events.agg(F.max("ts").alias("now"))
    ended = events.filter(F.col("state").isin("completed", "failed"))
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    age = seconds("now") - seconds("ts")
    young = ended.join(F.broadcast(now)).filter(age <= F.when(F.col("state") == "completed", completed_s).otherwise(failed_s))
    newest = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("ts"), F.desc("event_id")))
    return young.withColumn("nth", newest).filter(F.col("nth") <= most).select("event_id", "state")


def static_only(events: DataFrame, seconds: int = 600) -> DataFrame:
    """event_id, static: whether the event's host failed in the `seconds` before it, so that its pages are fetched without rendering."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    before = Window.partitionBy("host").orderBy("us").rangeBetween(-seconds * 1_000_000, -1)
    marked = events.withColumn("us", micros).withColumn("failures", F.count(F.when(F.col("state").isin("failed", STICKY), 1)).over(before))
    return marked.select("event_id", (F.col("failures") > 0).alias("static"))
