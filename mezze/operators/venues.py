"""Filters, listings, lookups, geography and statistics over venue documents."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6371000.0
SORTS = ("updated_at", "created_at", "rating", "name", "user_ratings_total")


@dataclass
class VenueFilter:
    """What a listing may ask for; None or '' asks for nothing. Flags take true and false words, too."""

    city: str | None = None
    district: str | None = None
    primary_type: str | None = None
    qr_provider: str | None = None
    data_source: str | None = None
    provider: str | None = None
    status: str | None = None
    has_qr_menu: object = None
    has_website: object = None
    supports_online_ordering: object = None
    has_email: object = None
    min_rating: float | None = None
    q: str | None = None

    def condition(self) -> Column:
        c = F.lit(True)
        for value, column in ((self.city, "address.city"), (self.district, "address.district")):
            if value:
                c &= F.lower(column).startswith(value.lower())
        equal = {"primary_type": self.primary_type, "digital_presence.qr_menu_provider": self.qr_provider, "data_source": self.data_source, "provider": self.provider, "enrichment.status": self.status}
        for column, value in equal.items():
            if value:
                c &= F.col(column) == value
        for name in ("has_qr_menu", "has_website", "supports_online_ordering"):
            if (flag := tri_state(getattr(self, name))) is not None:
                c &= F.col(f"digital_presence.{name}") == flag
        if (flag := tri_state(self.has_email)) is not None:
            c &= (F.size(F.coalesce("contacts.emails", F.array().cast("array<string>"))) > 0) == flag
        if self.min_rating is not None:
            c &= F.col("rating") >= float(self.min_rating)
        if self.q:
            c &= F.lower("name").contains(self.q.lower())
        return c


def tri_state(value) -> bool | None:
    if value in (None, "", "all"):
        return None
    return value is True or str(value).lower() in ("1", "true", "yes")


def list_venues(venues: DataFrame, wanted: VenueFilter, page: int = 1, limit: int = 20, sort: str = "updated_at", order: str = "desc") -> DataFrame:
    """A page of the venues that fit, by a column of SORTS (else the first) and then by id; nulls last."""
    by = F.col(sort if sort in SORTS else SORTS[0])
    by = by.asc_nulls_last() if order == "asc" else by.desc_nulls_last()
    limit = min(200, max(1, limit))
    return venues.filter(wanted.condition()).orderBy(by, "id").offset((max(1, page) - 1) * limit).limit(limit)


def list_total(venues: DataFrame, wanted: VenueFilter, limit: int = 20) -> DataFrame:
    return venues.filter(wanted.condition()).agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / limit))


def lookup_in(venues: DataFrame, keys: DataFrame) -> DataFrame:
    """Venues whose key is among `keys` (google_place_id)."""
    return venues.join(keys.select("google_place_id").distinct(), "google_place_id", "left_semi")


def new_places(places: DataFrame, venues: DataFrame, force: bool = False) -> DataFrame:
    """Places that are not stored yet, or all with `force`."""
    return places if force else places.join(venues.select("google_place_id"), "google_place_id", "left_anti")


def without(venues: DataFrame, ids: DataFrame) -> DataFrame:
    return venues.join(ids.select("id"), "id", "left_anti")


def lng() -> Column:
    return F.col("location.coordinates")[0]


def lat() -> Column:
    return F.col("location.coordinates")[1]


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres by the haversine formula."""
    half = lambda a, b: F.pow(F.sin(F.radians(a - b) / 2), 2)
    a = half(lat2, lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng2, lng1)
    return 2 * EARTH_M * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # null without a place


def around(lat0: float, lng0: float, radius_m: float) -> Column:
    """Bounding box of a circle: a cheap test that reaches the scan before the exact one; it may go across the 180th meridian."""
    d = math.degrees(radius_m / EARTH_M) * 1.001
    within = lat().between(lat0 - d, lat0 + d)
    if abs(lat0) + d >= 90:  # a pole lies in the circle, and so may any longitude
        return within
    wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(lat0)))))
    west, east = lng0 - wide, lng0 + wide
    box = lng().between(west, east)
    if west < -180:
        box |= lng() >= west + 360
    if east > 180:
        box |= lng() <= east - 360
    return within & box


def nearby(venues: DataFrame, lat0: float, lng0: float, radius_m: float = 2000, limit: int = 50) -> DataFrame:
    """Venues within the radius with distance_m, nearest first, then by id; those without a location are left out."""
    d = distance_m(F.lit(float(lat0)), F.lit(float(lng0)), lat(), lng())
    radius_m = min(100_000.0, float(radius_m))
    near = venues.filter(around(lat0, lng0, radius_m)).withColumn("distance_m", d).filter(F.col("distance_m") <= radius_m)
    return near.orderBy("distance_m", "id").limit(min(200, limit))


#: Venues of one place that a row lists, about; a place with more of them has several rows. From `CROWD` on it is a crowd.
PLACE_IDS, CROWD = 1024, 256


def _places(venues: DataFrame, name: str, n: str) -> DataFrame:
    """A row for the venues of one place, as a list of ids `name`: lat, lng and x, y, z on the unit sphere, each with the ending `n`.

    Places with more than `PLACE_IDS` venues are counted first, and theirs are dealt to rows by their ids (column `part`).
    """
    points = venues.select(F.col("id").alias("_id"), lat().alias("lat"), lng().alias("lng")).filter("lat IS NOT NULL AND lng IS NOT NULL")
    crowded = points.groupBy("lat", "lng").agg(F.ceil(F.count("*") / PLACE_IDS).alias("rows")).filter("rows > 1")
    part = F.pmod(F.xxhash64("_id"), F.coalesce("rows", F.lit(1)))
    listed = points.join(crowded, ["lat", "lng"], "left").groupBy("lat", "lng", part.alias("part")).agg(F.collect_list("_id").alias(name))
    x, y = F.radians("lng"), F.radians("lat")
    place = {"x": F.cos(y) * F.cos(x), "y": F.cos(y) * F.sin(x), "z": F.sin(y)}
    return listed.select(name, *[F.col(c).alias(f"{c}{n}") for c in ("part", "lat", "lng")], *[v.alias(f"{k}{n}") for k, v in place.items()])


def nearest_pairs(left: DataFrame, right: DataFrame, radius_m: float, digits: int | None = None) -> DataFrame:
    """id, other_id, distance_m of venues on either side within the radius: an equi-join on grid cells, then the exact test.

    The grid cuts space, not the map: points of the unit sphere lie in cubes of twice the chord that the radius spans, so
    there are no edges at poles and meridians, and cells are as large as the radius asks. A right-hand point stands in the
    cubes that its ball reaches, eight at most. Points that share a cube lie within a few radii of each other, however
    dense a city is: a share of the pairs that meet, which does not depend on the data, are results.

    Places meet, not venues: a pair of places is tested, and its distance rounded to `digits`, once for all venues there;
    the pairs of venues are then written out one by one. Where crowds meet crowds, that is dealt to all tasks.
    """
    chord = 2 * math.sin(min(math.pi / 2, max(0.0, radius_m) / EARTH_M / 2)) * 1.000001 + 1e-12
    axes, cells = ("x", "y", "z"), ["cx", "cy", "cz"]
    cell = lambda c: F.floor(c / (2 * chord)).cast("long")
    a = _places(left, "ids", "1").select("*", *[cell(F.col(f"{k}1")).alias(f"c{k}") for k in axes])
    b = _places(right, "other_ids", "2")
    for k in axes:
        b = b.select("*", F.explode(F.sequence(cell(F.col(f"{k}2") - chord), cell(F.col(f"{k}2") + chord))).alias(f"c{k}"))
    # Few places may make many pairs, so tasks are not merged by what they read.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = a.repartition(tasks, *cells), b.repartition(tasks, *cells)
    # The chord tells nearly all that are too far, without a sine.
    straight = sum((F.col(f"{k}1") - F.col(f"{k}2")) * (F.col(f"{k}1") - F.col(f"{k}2")) for k in axes)
    metres = distance_m(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    crowd = lambda ids: F.size(ids) >= CROWD

    def near(a: DataFrame, b: DataFrame) -> DataFrame:
        met = a.join(b, cells).filter(straight <= chord * chord).withColumn("distance_m", metres).filter(F.col("distance_m") <= radius_m)
        return met.withColumn("distance_m", F.col("distance_m") if digits is None else F.round("distance_m", digits))

    places = ["lat1", "lng1", "part1", "lat2", "lng2", "part2"]
    usual = near(a, b).filter(~(crowd("ids") & crowd("other_ids"))).select("ids", "other_ids", "distance_m")
    crowds = near(a.filter(crowd("ids")), b.filter(crowd("other_ids"))).select("ids", "other_ids", "distance_m", *places).repartition(tasks, *places).drop(*places)
    listed = usual.unionByName(crowds).select(F.explode("ids").alias("id"), "other_ids", "distance_m")
    return listed.select("id", F.explode("other_ids").alias("other_id"), "distance_m").filter("id <> other_id")


def within_bbox(venues: DataFrame, min_lng: float, min_lat: float, max_lng: float, max_lat: float, limit: int = 100) -> DataFrame:
    return venues.filter(lng().between(min_lng, max_lng) & lat().between(min_lat, max_lat)).orderBy("id").limit(min(500, limit))


def in_polygon(ring: list[tuple[float, float]]) -> Column:
    """Whether the venue is inside the ring of (lng, lat), closed by itself; planar edges, for polygons of a city's size."""
    if len(ring) < 3:
        raise ValueError("a polygon has at least three points")
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 != y2:
            at = F.lit(x1) + (lat() - y1) * (x2 - x1) / (y2 - y1)
            crossings += F.when(((F.lit(y1) > lat()) != (F.lit(y2) > lat())) & (lng() < at), 1).otherwise(0)
    return lat().isNotNull() & (crossings % 2 == 1)


def within_polygon(venues: DataFrame, ring: list[tuple[float, float]], limit: int = 100) -> DataFrame:
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = lng().between(min(xs), max(xs)) & lat().between(min(ys), max(ys))
    return venues.filter(box & in_polygon(ring)).orderBy("id").limit(min(500, limit))


def provider_radius(places: DataFrame, lat0: float, lng0: float, radius_m: float) -> DataFrame:
    """Places up to 1.25 times the radius away; those without a location stay."""
    d = distance_m(F.lit(float(lat0)), F.lit(float(lng0)), lat(), lng())
    return places.filter(lat().isNull() | (d <= 1.25 * radius_m))


def valid_point(lat: Column, lng: Column) -> Column:
    """In range, not NaN, and not the unset point around (0, 0)."""
    unset = (F.abs(lat) < 0.01) & (F.abs(lng) < 0.01)
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lng) <= 180) & ~F.isnan(lat) & ~F.isnan(lng) & ~unset, F.lit(False))


def radius_zoom(radius_m: Column) -> Column:
    """Map zoom for a radius: 15 at 2 km, one less for each doubling, between 10 and 19."""
    return F.least(F.lit(19), F.greatest(F.lit(10), F.floor(F.lit(15.5) - F.log2(F.greatest(F.lit(1.0), radius_m) / 2000.0)))).cast("int")


def rounded(x: Column, places: int) -> Column:
    """Half up, as on a number line."""
    return F.floor(x * 10**places + 0.5) / float(10**places)


def summary(venues: DataFrame, items: DataFrame) -> DataFrame:
    """One row: counts, average rating, menu items and the share of venues with a QR menu; zeros for no venues."""
    count = lambda c: F.count(F.when(c, 1))
    digital = "digital_presence."
    totals = venues.agg(
        F.count("*").alias("total"), count(F.col(f"{digital}has_website")).alias("with_website"), count(F.col(f"{digital}has_qr_menu")).alias("with_qr_menu"),
        count(F.col(f"{digital}supports_online_ordering")).alias("with_online_ordering"), count(F.size("contacts.emails") > 0).alias("with_email"), rounded(F.avg("rating"), 2).alias("avg_rating"),
    )
    menu = items.join(venues.select(F.col("id").alias("venue_id")), "venue_id", "left_semi").agg(F.count("*").alias("menu_items"))
    share = F.when(F.col("total") > 0, rounded(100 * F.col("with_qr_menu") / F.col("total"), 1)).otherwise(F.lit(0.0))
    # Both sides are one row each.
    return totals.join(menu).withColumn("qr_penetration", share)


def top_counts(venues: DataFrame, column: str, name: str, most: int | None = 15) -> DataFrame:
    """The most frequent values that are not null or empty, by count and then by name; all of them without `most`."""
    counted = venues.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n")).filter(F.col(name).isNotNull() & (F.col(name) != ""))
    return counted.orderBy(F.desc("n"), name).limit(most) if most else counted


def contacts_by(venues: DataFrame, by: str) -> DataFrame:
    """`by`, phone_numbers, emails: the distinct contacts of each group's venues, sorted, e-mails in lower case."""
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(name) for c, name in (("phones", "phone_numbers"), ("mails", "emails"))]
    some = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.length(F.trim(x)) > 0)
    rows = venues.select(F.col(by).alias("by"), some(F.col("contacts.phone_numbers")).alias("phones"), F.transform(some(F.col("contacts.emails")), lambda e: F.lower(F.trim(e))).alias("mails"))
    return rows.groupBy("by").agg(*sets)
