"""Venue tables bound to the star schema by integer arithmetic, in Spark and, for the checks, in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDERS = ("FineDine", "Menulux", "QrMatic", "Adisyo", "Qmenu")
SOURCES = ("maps_scraper", "outscraper", "apify", "places_api", "manual", "mock", "web")
STATUSES = ("pending", "queued", "processing", "completed", "failed", "captcha_blocked")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: tuple, by) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested venue document for each customer."""
    k = F.col("c_custkey")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    lng = F.lit(26.0) + (k * 7919 % 19000).cast("double") / 1000.0
    lat = F.lit(36.0) + (k * 104729 % 6000).cast("double") / 1000.0
    site, qr = k % 3 != 0, (k % 3 != 0) & (k % 2 == 0)
    text = k.cast("string")
    return joined.select(
        text.alias("id"), F.concat(F.lit("v_"), text).alias("google_place_id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("primary_type"),
        F.when(k % 11 != 0, (k % 41 + 10).cast("double") / 10.0).alias("rating"), (k % 997).cast("int").alias("user_ratings_total"),
        F.when(k % 13 != 0, F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))).alias("location"),
        F.struct(F.concat(F.lit("No:"), (k % 90).cast("string"), F.lit(" "), F.col("n_name")).alias("formatted"), F.col("r_name").alias("country"), F.col("n_name").alias("city"), F.concat(F.lit("d"), (k % 7).cast("string")).alias("district")).alias("address"),
        F.struct(
            F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("0532"), F.lpad((k % 10000000).cast("string"), 7, "0")))).alias("phone_numbers"),
            F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("info"), text, F.lit("@venue.com.tr")))).alias("emails"),
            F.when(site, F.concat(F.lit("https://www.venue"), text, F.lit(".com/Menu/"))).alias("website_url"),
        ).alias("contacts"),
        F.struct(
            site.alias("has_website"), qr.alias("has_qr_menu"), F.when(qr, _pick(PROVIDERS, k)).alias("qr_menu_provider"),
            F.when(qr & (k % 4 == 0), F.concat(F.lit("https://qr.example/"), text)).alias("qr_menu_url"), (k % 5 == 0).alias("supports_online_ordering"),
        ).alias("digital_presence"),
        _pick(SOURCES, k).alias("data_source"), F.when(k % 7 != 0, F.concat(F.lit("p"), (k % 4).cast("string"))).alias("provider"),
        F.struct(_pick(STATUSES, k).alias("status")).alias("enrichment"), F.timestamp_seconds(F.lit(1704067200) + k).alias("updated_at"), F.timestamp_seconds(F.lit(1700000000) + k * 7 % 1000).alias("created_at"),
    )


VENUES = f"""venues AS (
  SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS id, 'v_' || c_custkey AS google_place_id, c_name AS name, lower(c_mktsegment) AS primary_type,
    CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 41 + 10)::DOUBLE / 10e0 END AS rating, (c_custkey % 997)::INTEGER AS user_ratings_total,
    CASE WHEN c_custkey % 13 <> 0 THEN 26e0 + (c_custkey * 7919 % 19000)::DOUBLE / 1000e0 END AS lng,
    CASE WHEN c_custkey % 13 <> 0 THEN 36e0 + (c_custkey * 104729 % 6000)::DOUBLE / 1000e0 END AS lat,
    'No:' || c_custkey % 90 || ' ' || n_name AS formatted, r_name AS country, n_name AS city, 'd' || c_custkey % 7 AS district,
    CASE WHEN c_custkey % 6 = 0 THEN []::VARCHAR[] ELSE ['0532' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0')] END AS phone_numbers,
    CASE WHEN c_custkey % 4 = 0 THEN []::VARCHAR[] ELSE ['info' || c_custkey || '@venue.com.tr'] END AS emails,
    CASE WHEN c_custkey % 3 <> 0 THEN 'https://www.venue' || c_custkey || '.com/Menu/' END AS website_url,
    c_custkey % 3 <> 0 AS has_website, c_custkey % 3 <> 0 AND c_custkey % 2 = 0 AS has_qr_menu,
    CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 0 THEN {list(PROVIDERS)}[c_custkey % 5 + 1] END AS qr_menu_provider,
    CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 = 0 THEN 'https://qr.example/' || c_custkey END AS qr_menu_url,
    c_custkey % 5 = 0 AS supports_online_ordering, {list(SOURCES)}[c_custkey % 7 + 1] AS data_source,
    CASE WHEN c_custkey % 7 <> 0 THEN 'p' || c_custkey % 4 END AS provider, {list(STATUSES)}[c_custkey % 6 + 1] AS status,
    make_timestamp((1704067200 + c_custkey) * 1000000) AS updated_at, make_timestamp((1700000000 + c_custkey * 7 % 1000) * 1000000) AS created_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


#: Rows of a task that makes or merges menu rows, so that its memory does not grow with the table.
TASK_ROWS = 500_000


def menu_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks for the menu rows: as many as run at once, or as `TASK_ROWS` asks. The rows are counted from the files' footers."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(table(spark, sf_dir, "lineitem").count() / TASK_ROWS))


def menu_rows(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """venue_id, category, page, ord, name, price, image: a row for each line item, priced and named by its part.

    Line items are narrow and rows are wide, so tasks that are cut by what they read get many rows; `tasks` deals them first.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    if tasks:
        lines = lines.repartition(tasks, "l_orderkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("o_custkey").cast("string").alias("venue_id"), F.col("o_orderpriority").alias("category"), F.col("l_orderkey").alias("page"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10000000 + F.col("l_partkey")).alias("ord"),
        F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("https://img.example/w_100,h_90/"), F.col("l_partkey").cast("string"), F.lit(".jpg?w=100&q=30"))).alias("image"),
    )


MENU_ROWS = """menu_rows AS (
  SELECT CAST(o_custkey AS VARCHAR) AS venue_id, o_orderpriority AS category, l_orderkey AS page, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS ord, p_name AS name, p_retailprice AS price,
    CASE WHEN l_partkey % 3 = 0 THEN 'https://img.example/w_100,h_90/' || l_partkey || '.jpg?w=100&q=30' END AS image
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""


def line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, ord, line: the lines of documents with a character other than a space, in order."""
    split = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "line"))
    return split.filter(F.trim("line") != "")


LINES = """lines AS (
  SELECT page, CAST(ord AS INTEGER) AS ord, line FROM (
    SELECT doc_id AS page, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS ord, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
  ) WHERE trim(line, ' ') <> ''
)"""

STATES = {"signup": "queued", "click": "processing", "purchase": "completed", "error": "failed", "view": "queued"}


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, place_id, host, kind, state, ts: events as steps of one job for each user, four users to a host."""
    k = F.col("user_id")
    state = F.coalesce(*[F.when(F.col("event_type") == e, s) for e, s in STATES.items()])
    state = F.when((F.col("event_type") == "error") & (F.col("event_id") % 10 == 0), "captcha_blocked").otherwise(state)
    url = F.concat(F.lit("https://www.venue"), F.floor(k / 4).cast("string"), F.lit(".com/Menu/"), k.cast("string"))
    kind = F.when(k % 10 == 3, "discover").otherwise("enrich")
    return table(spark, sf_dir, "events").select("event_id", k.alias("place_id"), F.parse_url(url, F.lit("HOST")).alias("host"), kind.alias("kind"), state.alias("state"), "ts")


JOBS = f"""jobs AS (
  SELECT event_id, user_id AS place_id, 'www.venue' || user_id // 4 || '.com' AS host, CASE WHEN user_id % 10 = 3 THEN 'discover' ELSE 'enrich' END AS kind, ts,
    CASE WHEN event_type = 'error' AND event_id % 10 = 0 THEN 'captcha_blocked'
    {' '.join(f"WHEN event_type = '{e}' THEN '{s}'" for e, s in STATES.items())} END AS state
  FROM events
)"""
