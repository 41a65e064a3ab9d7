"""Queries over venue documents: statistics, listings, lookups, geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from mezze.operators import venues as ops
from mezze.operators.venues import VenueFilter
from mezze.plans.views import MENU_ROWS, VENUES, menu_rows, venues

#: A place in the middle of the test venues, and a polygon around it as (lng, lat).
CENTRE = (39.0, 35.0)
RING = [(30.0, 37.0), (41.0, 37.5), (39.5, 41.0), (33.0, 41.5), (31.0, 39.0)]


def _flat(df):
    """Scalar columns of a venue document."""
    return df.select("id", "google_place_id", "name", "primary_type", "rating", "user_ratings_total", ops.lng().alias("lng"), ops.lat().alias("lat"), F.col("address.city").alias("city"), F.col("address.district").alias("district"), F.col("digital_presence.has_qr_menu").alias("has_qr_menu"), "updated_at")


_COLUMNS = "id, google_place_id, name, primary_type, rating, user_ratings_total, lng, lat, city, district, has_qr_menu, updated_at"
_IDS = lambda df: df.select("id", "name", F.col("address.city").alias("city"))
_WITH = f"WITH {VENUES}"
_D = "2e0 * 6371000e0 * asin(sqrt(pow(sin(radians(lat - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians(lat)) * pow(sin(radians(lng - {lng}) / 2), 2)))"


def _filtered(**wanted):
    return lambda s, d: _IDS(venues(s, d).filter(VenueFilter(**wanted).condition()))


def _where(condition: str) -> str:
    return f"{_WITH} SELECT id, name, city FROM venues WHERE {condition}"


def _keys(s, d):
    """Every third customer's key, and some that no venue has."""
    return venues(s, d).filter(F.col("id").cast("long") % 3 == 0).select("google_place_id", "id").unionByName(s.createDataFrame([("v_none", "none")], "google_place_id string, id string"))


def _distances(s, d):
    return venues(s, d).select("id", F.round(ops.distance_m(F.lit(CENTRE[0]), F.lit(CENTRE[1]), ops.lat(), ops.lng()), 3).alias("metres"))


def _polygon_sql() -> str:
    edges = ", ".join(f"({x1}e0, {y1}e0, {x2}e0, {y2}e0)" for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]]))
    return f"""{_WITH}, edges(x1, y1, x2, y2) AS (VALUES {edges}),
hits AS (SELECT id, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lng < x1 + (lat - y1) * (x2 - x1) / (y2 - y1)) AS n FROM venues, edges WHERE lat IS NOT NULL GROUP BY id)
SELECT id, name, city FROM venues JOIN hits USING (id) WHERE n % 2 = 1 ORDER BY id LIMIT 100"""


_ALL = VenueFilter(city="", has_website="yes", has_email=True, min_rating=2.0, status="failed")
_SUMMARY = f"""{_WITH}, {MENU_ROWS}, t AS (
  SELECT count(*) AS total, count(*) FILTER (has_website) AS with_website, count(*) FILTER (has_qr_menu) AS with_qr_menu, count(*) FILTER (supports_online_ordering) AS with_online_ordering,
    count(*) FILTER (len(emails) > 0) AS with_email, floor(avg(rating) * 100 + 0.5e0) / 100e0 AS avg_rating FROM venues
) SELECT *, (SELECT count(*) FROM menu_rows SEMI JOIN venues ON venue_id = id) AS menu_items, CASE WHEN total > 0 THEN floor(100e0 * with_qr_menu / total * 10 + 0.5e0) / 10e0 ELSE 0e0 END AS qr_penetration FROM t"""

def _globe(s, d):
    """The venues moved to both sides of the 180th meridian, from pole to pole."""
    k, wrapped = F.col("id").cast("long"), lambda x: F.when(x > 180, x - 360).otherwise(x)
    point = F.array(wrapped((ops.lng() - 26) / 2 + 175), (ops.lat() - 36) * 30 - 90)
    return venues(s, d).withColumn("location", F.when(ops.lat().isNotNull() & (k % 2 == 0), F.struct(F.lit("Point").alias("type"), point.alias("coordinates"))))


_GLOBE = f"{_WITH}, globe AS (SELECT id, CASE WHEN (lng - 26) / 2 + 175 > 180 THEN (lng - 26) / 2 + 175 - 360 ELSE (lng - 26) / 2 + 175 END AS lng, (lat - 36) * 30 - 90 AS lat FROM venues WHERE lat IS NOT NULL AND k % 2 = 0)"

QUERIES = {
    "stats_summary": (lambda s, d: ops.summary(venues(s, d), menu_rows(s, d).select("venue_id")), _SUMMARY),
    "stats_by_provider": (lambda s, d: ops.top_counts(venues(s, d), "digital_presence.qr_menu_provider", "provider"), f"{_WITH} SELECT qr_menu_provider AS provider, count(*) AS n FROM venues WHERE qr_menu_provider <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15"),
    "stats_by_city": (lambda s, d: ops.top_counts(venues(s, d), "address.city", "city"), f"{_WITH} SELECT city, count(*) AS n FROM venues WHERE city <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15"),
    "stats_by_source": (lambda s, d: ops.top_counts(venues(s, d), "data_source", "data_source", None), f"{_WITH} SELECT data_source, count(*) AS n FROM venues GROUP BY 1"),
    "scan_venues": (lambda s, d: _flat(venues(s, d)), f"{_WITH} SELECT {_COLUMNS} FROM venues"),
    "venue_by_id": (lambda s, d: _flat(venues(s, d).filter(F.col("id") == "42").limit(1)), f"{_WITH} SELECT {_COLUMNS} FROM venues WHERE id = '42'"),
    "lookup_in": (lambda s, d: _IDS(ops.lookup_in(venues(s, d), _keys(s, d))), _where("k % 3 = 0")),
    "new_places_only": (lambda s, d: _IDS(ops.new_places(venues(s, d), _keys(s, d))), _where("k % 3 <> 0")),
    "delete_venue": (lambda s, d: _IDS(ops.without(venues(s, d), _keys(s, d))), _where("k % 3 <> 0")),
    "filter_city": (_filtered(city="n", district="D3"), _where("starts_with(lower(city), 'n') AND starts_with(lower(district), 'd3')")),
    "filter_eq": (_filtered(primary_type="building", data_source="apify", provider="p2"), _where("primary_type = 'building' AND data_source = 'apify' AND provider = 'p2'")),
    "filter_bool": (_filtered(has_qr_menu="true", supports_online_ordering="0", has_website="all"), _where("has_qr_menu AND NOT supports_online_ordering")),
    "filter_has_email": (_filtered(has_email="no"), _where("len(emails) = 0")),
    "filter_min_rating": (_filtered(min_rating=4.5), _where("rating >= 4.5e0")),
    "filter_q": (_filtered(q="ER#00000001"), _where("contains(lower(name), 'er#00000001')")),
    "filter_all": (lambda s, d: _IDS(venues(s, d).filter(_ALL.condition())), _where("has_website AND len(emails) > 0 AND rating >= 2e0 AND status = 'failed'")),
    "list_page": (lambda s, d: _flat(ops.list_venues(venues(s, d), VenueFilter(has_website=True), page=3, limit=25)), f"{_WITH} SELECT {_COLUMNS} FROM venues WHERE has_website ORDER BY updated_at DESC, id LIMIT 25 OFFSET 50"),
    "list_sorted": (lambda s, d: _flat(ops.list_venues(venues(s, d), VenueFilter(), limit=200, sort="rating", order="asc")), f"{_WITH} SELECT {_COLUMNS} FROM venues ORDER BY rating ASC NULLS LAST, id LIMIT 200"),
    "list_total": (lambda s, d: ops.list_total(venues(s, d), VenueFilter(has_website=True)), f"{_WITH} SELECT count(*) AS total, ceil(count(*) / 20e0)::BIGINT AS pages FROM venues WHERE has_website"),
    "distance": (_distances, f"{_WITH} SELECT id, round({_D.format(lat=f'{CENTRE[0]}e0', lng=f'{CENTRE[1]}e0')}, 3) AS metres FROM venues"),
    "nearby": (lambda s, d: ops.nearby(venues(s, d), *CENTRE, radius_m=100_000).select("id", F.round("distance_m", 3).alias("metres")), f"{_WITH}, m AS (SELECT id, {_D.format(lat=f'{CENTRE[0]}e0', lng=f'{CENTRE[1]}e0')} AS m FROM venues) SELECT id, round(m, 3) AS metres FROM m WHERE m <= 100000 ORDER BY m, id LIMIT 50"),
    "nearest_pairs": (
        lambda s, d: ops.nearest_pairs(venues(s, d), venues(s, d), 15_000, digits=3).withColumnRenamed("distance_m", "metres"),
        f"{_WITH}, p AS (SELECT a.id, b.id AS other_id, {_D.format(lat='a.lat', lng='a.lng').replace('(lat -', '(b.lat -').replace('radians(lat)', 'radians(b.lat)').replace('(lng -', '(b.lng -')} AS m FROM venues a JOIN venues b ON a.id <> b.id) SELECT id, other_id, round(m, 3) AS metres FROM p WHERE m <= 15000",
    ),
    "nearest_pairs_globe": (
        lambda s, d: ops.nearest_pairs(_globe(s, d), _globe(s, d), 150_000, digits=2).withColumnRenamed("distance_m", "metres"),
        f"{_GLOBE}, p AS (SELECT a.id, b.id AS other_id, {_D.format(lat='a.lat', lng='a.lng').replace('(lat -', '(b.lat -').replace('radians(lat)', 'radians(b.lat)').replace('(lng -', '(b.lng -')} AS m FROM globe a JOIN globe b ON a.id <> b.id) SELECT id, other_id, round(m, 2) AS metres FROM p WHERE m <= 150000",
    ),
    "nearby_globe": (
        lambda s, d: ops.nearby(_globe(s, d), -89.2, 179.95, radius_m=100_000).select("id", F.round("distance_m", 2).alias("metres")),
        f"{_GLOBE}, m AS (SELECT id, {_D.format(lat='-89.2e0', lng='179.95e0')} AS m FROM globe) SELECT id, round(m, 2) AS metres FROM m WHERE m <= 100000 ORDER BY m, id LIMIT 50",
    ),
    "contacts_distinct": (
        lambda s, d: ops.contacts_by(venues(s, d), "address.city").select(F.col("by").alias("city"), *[F.array_join(c, "|").alias(c) for c in ("phone_numbers", "emails")]),
        f"""{_WITH}, p AS (SELECT city, string_agg(DISTINCT phone, '|' ORDER BY phone) AS phone_numbers FROM (SELECT city, unnest(phone_numbers) AS phone FROM venues) GROUP BY 1),
e AS (SELECT city, string_agg(DISTINCT email, '|' ORDER BY email) AS emails FROM (SELECT city, lower(unnest(emails)) AS email FROM venues) GROUP BY 1)
SELECT c.city, coalesce(phone_numbers, '') AS phone_numbers, coalesce(emails, '') AS emails FROM (SELECT DISTINCT city FROM venues) c LEFT JOIN p USING (city) LEFT JOIN e USING (city)""",
    ),
    "within_bbox": (lambda s, d: _IDS(ops.within_bbox(venues(s, d), 30, 37, 36, 40)), _where("lng BETWEEN 30 AND 36 AND lat BETWEEN 37 AND 40 ORDER BY id LIMIT 100")),
    "within_polygon": (lambda s, d: _IDS(ops.within_polygon(venues(s, d), RING)), _polygon_sql()),
    "provider_radius": (lambda s, d: _IDS(ops.provider_radius(venues(s, d), *CENTRE, radius_m=200_000)), _where(f"lat IS NULL OR {_D.format(lat=f'{CENTRE[0]}e0', lng=f'{CENTRE[1]}e0')} <= 250000e0")),
    "valid_point": (
        lambda s, d: venues(s, d).select("id", ops.valid_point((ops.lat() - 38) * 40, (ops.lng() - 35) * 20).alias("valid")),
        f"{_WITH} SELECT id, coalesce(abs((lat - 38) * 40) <= 90 AND abs((lng - 35) * 20) <= 180 AND NOT (abs((lat - 38) * 40) < 0.01e0 AND abs((lng - 35) * 20) < 0.01e0), false) AS valid FROM venues",
    ),
    "radius_zoom": (
        lambda s, d: venues(s, d).select("id", ops.radius_zoom(F.col("user_ratings_total").cast("double") * 100).alias("zoom")),
        f"{_WITH} SELECT id, least(19, greatest(10, floor(15.5e0 - log2(greatest(1e0, user_ratings_total::DOUBLE * 100) / 2000e0))))::INTEGER AS zoom FROM venues",
    ),
}
