"""Providers, precedence of fields, geocoding, enrichment and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mezze.functions import scalars
from mezze.operators.menus import first_by
from mezze.operators.venues import valid_point

ROW_A = "place_id string, google_id string, cid string, name string, full_address string, address string, latitude double, longitude double, rating double, reviews int, phone string, site string, website string, type string, subtypes string, city string, district string, borough string, postal_code string, plus_code string, working_hours map<string,string>, photo string"
ROW_B = "placeId string, cid string, fid string, title string, address string, location struct<lat:double,lng:double>, totalScore double, reviewsCount int, phone string, website string, categories array<string>, categoryName string, openingHours array<struct<day:string,hours:string>>, plusCode string, city string, neighborhood string, postalCode string, imageUrl string"


def some(*columns) -> Column:
    """The first that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def _place(key, name, address, lat, lng, rating, reviews, phone, website, types, city, district, neighborhood, postal) -> list[Column]:
    parsed = scalars.parse_address(address)
    return [
        key.alias("place_id"), name.alias("name"), address.alias("formatted_address"), lat.alias("lat"), lng.alias("lng"), rating.alias("rating"), reviews.alias("user_ratings_total"), phone.alias("phone"), website.alias("website"), types.alias("types"),
        F.struct(some(city, parsed["city"]).alias("city"), some(district, parsed["district"]).alias("district"), some(neighborhood, parsed["neighborhood"]).alias("neighborhood"), some(postal, parsed["postal_code"]).alias("postal_code")).alias("address_parts"),
    ]


def normalize_a(raw: DataFrame) -> DataFrame:
    """Place rows of JSON rows (column json) of the first hosted source; rows without an id or a name go."""
    r = raw.select(F.from_json("json", ROW_A).alias("r")).select("r.*")
    subtypes = F.transform(F.split("subtypes", ","), lambda s: F.trim(s))
    types = F.when(some("type").isNotNull(), F.array("type")).when(some("subtypes").isNotNull(), subtypes).otherwise(F.array(F.lit("restaurant")))
    c = F.col
    columns = _place(some("place_id", "google_id", "cid"), c("name"), some("full_address", "address"), c("latitude"), c("longitude"), c("rating"), c("reviews"), c("phone"), some("site", "website"), types, c("city"), c("district"), c("borough"), c("postal_code"))
    hours = F.transform(F.map_entries("working_hours"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])).alias("weekday_text")
    return r.select(*columns, hours).filter(some("place_id").isNotNull() & some("name").isNotNull())


def normalize_b(raw: DataFrame) -> DataFrame:
    """Place rows of JSON rows of the second hosted source; its neighbourhood stands for the district, too."""
    r = raw.select(F.from_json("json", ROW_B).alias("r")).select("r.*")
    types = F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array(some("categoryName", F.lit("restaurant"))))
    c = F.col
    columns = _place(some("placeId", "cid", "fid"), c("title"), c("address"), c("location.lat"), c("location.lng"), c("totalScore"), c("reviewsCount"), c("phone"), c("website"), types, c("city"), c("neighborhood"), c("neighborhood"), c("postalCode"))
    return r.select(*columns, scalars.join_hours(F.col("openingHours")).alias("weekday_text")).filter(some("place_id").isNotNull() & some("name").isNotNull())


def provider_chain(attempts: DataFrame) -> DataFrame:
    """request_id, provider, n_attempts, blocked: the first provider in order that answered, even with nothing.

    attempts: request_id, rank, provider, configured, ok. Providers that are not configured are passed over; of a provider
    named twice the first place counts.
    """
    tried = first_by(attempts.filter("configured"), ["request_id", "provider"], ["rank"])
    answered = F.when(F.col("ok"), F.struct("rank", "provider"))
    chosen = tried.groupBy("request_id").agg(F.min(answered).alias("first"), F.count("*").alias("n"), F.collect_list("rank").alias("ranks"))
    n = F.when(F.col("first").isNull(), F.col("n")).otherwise(F.size(F.filter("ranks", lambda r: r <= F.col("first.rank"))))
    return chosen.select("request_id", F.col("first.provider").alias("provider"), n.cast("long").alias("n_attempts"), F.col("first").isNull().alias("blocked"))


def fill_details(places: DataFrame, details: DataFrame, columns: list[str]) -> DataFrame:
    """Places with the details' values first, by place_id; places without details stay as they are."""
    d = details.select(F.col("place_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = places.join(d, F.col("place_id") == F.col("_id"), "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in places.columns])


def geocode_candidates(address: Column, neighborhood: Column, district: Column, city: Column) -> Column:
    """Queries for a geocoder, the most exact first."""
    door = F.regexp_replace(address, r"(?i)^(.*?)no:\s*[0-9]+[a-z]?", "$1")
    tidy = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(door, r"[/\\()]", " "), r"\s+", " ")), F.lit(""))
    join = lambda *c: F.concat_ws(", ", *c)
    d, c, n = some(district), some(city), some(neighborhood)
    return F.array_compact(F.array(tidy, F.when(n.isNotNull() & d.isNotNull() & c.isNotNull(), join(n, d, c)), F.when(d.isNotNull() & c.isNotNull(), join(d, c)), c))


def geocode(places: DataFrame, geocodes: DataFrame) -> DataFrame:
    """place_id, lat, lng: the first candidate (array column) with a valid answer in geocodes (query, lat, lng)."""
    asked = places.select("place_id", F.posexplode("candidates").alias("nth", "query"))
    hits = asked.join(geocodes.filter(valid_point(F.col("lat"), F.col("lng"))), "query")
    return hits.groupBy("place_id").agg(F.min(F.struct("nth", "lat", "lng")).alias("p")).select("place_id", "p.lat", "p.lng")


def enrich(places: DataFrame, scans: DataFrame, points: DataFrame) -> DataFrame:
    """Venue rows of places (place_id, name, lat, lng, phone, website), their sites' scans (place_id, site_name, emails,
    phones, site_lat, site_lng, qr_menu_url) and geocoded points (place_id, geo_lat, geo_lng).

    What a provider says comes before what a page says, and that before geocoding; an empty string says nothing, and a point
    out of range is none.
    """
    joined = places.join(scans, "place_id", "left").join(points, "place_id", "left")
    choices = [("lat", "lng"), ("site_lat", "site_lng"), ("geo_lat", "geo_lng")]
    point = F.coalesce(*[F.when(valid_point(F.col(a), F.col(b)), F.struct(F.col(a).alias("lat"), F.col(b).alias("lng"))) for a, b in choices])
    source = F.coalesce(*[F.when(valid_point(F.col(a), F.col(b)), F.lit(s)) for (a, b), s in zip(choices, ("provider", "page", "geocoder"))])
    phones = F.array_distinct(F.filter(F.concat(F.array(scalars.normalize_phone(F.col("phone"))), F.coalesce("phones", F.array().cast("array<string>"))), lambda p: p.isNotNull()))
    return joined.select(
        F.col("place_id").alias("google_place_id"), some("name", "site_name").alias("name"), point["lat"].alias("lat"), point["lng"].alias("lng"), source.alias("point_source"), phones.alias("phone_numbers"),
        F.coalesce("emails", F.array().cast("array<string>")).alias("emails"), some("website").alias("website_url"), some("qr_menu_url", "website").alias("menu_url"),
    )


def enrich_report(venues: DataFrame) -> DataFrame:
    """google_place_id, status, missing: what an enriched venue still lacks."""
    lacks = F.array_compact(F.array(F.when(F.col("lat").isNull(), "location"), F.when(F.size("phone_numbers") == 0, "phone"), F.when(F.size("emails") == 0, "email"), F.when(F.col("menu_url").isNull(), "menu")))
    return venues.select("google_place_id", F.when(F.size(lacks) == 4, "failed").otherwise("completed").alias("status"), F.array_join(lacks, ",").alias("missing"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "google_place_id", keep: tuple[str, ...] = ("created_at",), order: str = "updated_at") -> DataFrame:
    """A new snapshot: incoming rows in place of stored ones with their key, but for `keep`; the latest of several incoming.

    One full outer join on the key. Columns are those of `stored`; what incoming lacks stays as stored, what it has as null
    becomes null. A row without a value of `order` is older than any with one; of equal ones that whose columns come
    last in order, so that a rerun chooses alike. A null key is a key of its own, and matches itself.
    """
    sortable = [F.col(f"`{c}`") if "map<" not in t and t != "variant" else F.to_json(F.col(f"`{c}`")) for c, t in incoming.dtypes]
    age = F.struct(F.col(order).isNotNull(), F.col(order), *sortable)
    latest = incoming.groupBy(key).agg(F.max_by(F.struct(*incoming.columns), age).alias("new"))
    old = stored.select(F.col(key).alias("_key"), F.struct(*stored.columns).alias("old"))
    joined = old.join(latest, F.col("_key").eqNullSafe(F.col(key)), "full_outer")

    def column(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(f"old.{c}")
        if c in keep:
            return F.coalesce(f"old.{c}", f"new.{c}")
        return F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))

    return joined.select(*[column(c).alias(c) for c in stored.columns])
