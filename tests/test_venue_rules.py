"""Rules that hold whatever the tables say, edge cases, and the streaming twins of the job queries."""

import csv
import io
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from mezze.functions import scalars
from mezze.operators import enrich, export, jobs, menus, pages, venues
from mezze.operators.venues import VenueFilter
from mezze.plans import pipeline_queries
from mezze.plans.views import job_events, menu_rows
from mezze.plans.views import venues as venue_rows
from mezze.streaming import jobs as streaming


@pytest.fixture(scope="module")
def v(spark, sf_dir):
    return venue_rows(spark, sf_dir).cache()


def ids(df):
    return {r["id"] for r in df.select("id").collect()}


def one(spark, f, *values):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string").orderBy("i").select(f(F.col("x"))).collect()]


def test_nearby_lies_in_its_box_and_pairs_agree(v):
    near = venues.nearby(v, 39.0, 35.0, 100_000, 200)
    assert ids(near) == ids(v.filter(venues.distance_m(F.lit(39.0), F.lit(35.0), venues.lat(), venues.lng()) <= 100_000))
    assert ids(near) <= ids(v.filter(venues.around(39.0, 35.0, 100_000)))
    pairs = {(r["id"], r["other_id"]) for r in venues.nearest_pairs(v, v, 90_000).collect()}
    assert pairs and pairs == {(b, a) for a, b in pairs}


def test_pages_of_a_listing_tile_it(v):
    wanted = VenueFilter(has_website=True)
    total = venues.list_total(v, wanted, 40).first()
    seen = [r["id"] for page in range(1, total["pages"] + 1) for r in venues.list_venues(v, wanted, page, 40).select("id").collect()]
    assert len(seen) == len(set(seen)) == total["total"]


def test_filters_take_what_clients_send(v):
    assert ids(v.filter(VenueFilter(city="(", q="%").condition())) == set()
    assert ids(v.filter(VenueFilter(has_website="all", city="").condition())) == ids(v)
    yes, no = ids(v.filter(VenueFilter(has_email="1").condition())), ids(v.filter(VenueFilter(has_email="0").condition()))
    assert yes | no == ids(v) and not yes & no


def test_empty_tables(spark, v):
    none = v.limit(0)
    row = venues.summary(none, spark.createDataFrame([], "venue_id string")).first()
    assert row["total"] == row["menu_items"] == row["qr_penetration"] == 0 and row["avg_rating"] is None
    assert venues.top_counts(none, "address.city", "city").count() == venues.nearby(none, 1, 1).count() == 0
    assert export.csv_lines(none.withColumn("categories", F.lit(None).cast(f"array<struct<category_id:string,name:string,items:array<{menus.ITEM}>>>"))).count() == 0


def test_merging_and_promotions_are_idempotent(spark, sf_dir):
    rows = menu_rows(spark, sf_dir)
    merged = menus.merge_pages(rows)
    assert sorted(menus.merge_pages(merged).collect()) == sorted(merged.collect())
    single = menus.promotion_last(rows)
    assert sorted(menus.promotion_last(single).collect()) == sorted(single.collect())


def test_promotions_come_last(spark):
    rows = [("v", "Öne Çıkanlar", 1, "Latte", 9.0), ("v", "Kahveler", 2, " latte", 10.0), ("v", "Popüler", 3, "Tea", 1.0), ("v", "FEATURED", 4, "tea", 2.0), ("w", "x", 1, "Latte", 3.0)]
    got = menus.promotion_last(spark.createDataFrame(rows, "venue_id string, category string, ord long, name string, price double")).collect()
    assert sorted((r["venue_id"], r["ord"]) for r in got) == [("v", 2), ("v", 3), ("w", 1)]


def test_upserting_twice_changes_nothing(spark):
    stored = spark.createDataFrame([("a", "A", 1), ("b", "B", 1)], "google_place_id string, name string, created_at int").withColumn("updated_at", F.lit(1))
    incoming = spark.createDataFrame([("b", None, 2, 5), ("c", "C", 3, 6), ("c", "C2", 4, 7)], "google_place_id string, name string, created_at int, updated_at int")
    once = enrich.upsert(stored, incoming)
    assert sorted(map(tuple, once.collect())) == [("a", "A", 1, 1), ("b", None, 1, 5), ("c", "C2", 4, 7)]
    assert sorted(enrich.upsert(once, incoming).collect()) == sorted(once.collect())


def test_scalar_literals(spark):
    assert one(spark, scalars.normalize_phone, "+90 (532) 123 45 67", "0312 1234567", "+442071234567", "", None, "012") == ["+905321234567", "+903121234567", "+442071234567", None, None, None]
    assert one(spark, scalars.parse_price, "₺110,00", "1.250,50 TL", "", None, "abc", "0") == [110.0, 1250.5, None, None, None, None]
    assert one(spark, scalars.parse_rating, "4,7", None, "9") == [4.7, None, None]
    assert one(spark, scalars.fold_text, "İÇLİ KÖFTE (IZGARA)", None) == ["icli kofte izgara", ""]
    assert one(spark, scalars.url_key, "HTTPS://A.com/x/?q=1", "https://a.com/x")[0] == one(spark, scalars.url_key, "https://a.com/x")[0]


def test_csv_lines_are_csv(spark, sf_dir, v):
    odd = v.limit(1).withColumn("name", F.lit('a "b", c;\nd')).withColumn("categories", F.lit(None).cast(f"array<struct<category_id:string,name:string,items:array<{menus.ITEM}>>>"))
    line = export.csv_lines(odd).first()["line"]
    cells = next(csv.reader(io.StringIO(line, newline="")))
    assert len(cells) == len(export.CSV_COLUMNS) == 28 and cells[2] == 'a "b", c;\nd' and cells[20] == cells[21] == "0"
    assert export.csv_header().startswith("﻿id,google_place_id,")


def test_json_and_xml_hold_the_same_venues(spark, sf_dir, v):
    rows = pipeline_queries._exported(spark, sf_dir)
    documents = {r["id"]: json.loads(r["json"]) for r in export.json_lines(rows).collect()}
    elements = {r["id"]: ET.fromstring(r["xml"]) for r in export.xml_elements(rows).collect()}
    assert documents.keys() == elements.keys() == ids(v)
    for k, doc in documents.items():
        e = elements[k]
        assert e.find("name").text == doc["name"] and e.get("id") == k
        assert (doc["location"] is None) == ("lat" not in e.find("location").attrib)
        assert [c.get("name") for c in e.find("menu")] == [c["name"] for c in doc["menu"]["categories"] or []]


def test_robots_groups(spark):
    bodies = [("o", "User-agent: a\nUser-agent: *\nDisallow: /x\nUser-agent: b\nDisallow: /y"), ("p", "Disallow: /all\n")]
    rules = pages.robots_rules(spark.createDataFrame(bodies, "origin string, body string")).collect()
    assert [tuple(r) for r in rules] == [("o", "/x", False)]


def test_menu_sections_of_any_depth(spark):
    import json

    section = {"name": "s30", "hasMenuItem": {"name": "i30"}}
    for n in range(29, -1, -1):
        section = {"name": f"s{n}", "menuItem": [{"name": f"i{n}", "offers": {"price": "1.5"}}], "hasMenuSection": section}
    menu = {"@type": "Menu", "hasMenuItem": [{"name": "unread"}], "menuSection": [section, None, {"name": None, "hasMenuItem": [{"name": "last"}, 3]}]}
    html = lambda node: f'<script type="application/ld+json">{json.dumps(node)}</script>'
    pages_ = spark.createDataFrame([(1, html(menu)), (2, html({"@type": "Menu", "menuItem": {"name": "own"}})), (3, None), (4, html({"@type": "Cafe"}))], "page_id long, html string")
    got = [(r["page_id"], r["category"], r["ord"], r["name"]) for r in pages.structured_menu(pages_).orderBy("page_id", "ord").collect()]
    assert got == [*((1, f"s{n}", n, f"i{n}") for n in range(31)), (1, "Menü", 31, "last"), (2, "Menü", 0, "own")]
    assert pages.structured_menu(pages_.limit(0)).count() == 0


def test_photo_rules(spark):
    items = spark.createDataFrame([("v", 1, "Kıymalı Pide", None), ("v", 2, "Adana Kebap Porsyon", None), ("v", 3, "Çay", None), ("v", 4, "kg", None), ("v", 5, "Adana", "has.png")], "venue_id string, ord long, name string, image string")
    posts = spark.createDataFrame([("v", 2, "second", "kiymali pide ve çay"), ("v", 1, "first", "Bugün KIYMALI PİDE!"), ("v", 3, "third", "kebap adana usulü"), ("w", 0, "other", "çay")], "venue_id string, nth int, image_url string, text string")
    assert {(r["ord"], r["photo"]) for r in menus.match_photos(items, posts).collect()} == {(1, "first"), (2, "third"), (3, "second")}


def streamed(df, spark, tmp_path, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


@pytest.fixture
def stream(spark, sf_dir, tmp_path):
    job_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/events")
    return lambda: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/events").schema).parquet(f"{tmp_path}/events")


def test_streams_agree_with_batches(spark, sf_dir, tmp_path, stream):
    events = job_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    first = streamed(streaming.dedup(stream(), "60 days"), spark, tmp_path, "deduped", "append")
    assert {r["place_id"] for r in first.collect()} == {r["place_id"] for r in jobs.dedup(events).collect()}
    assert first.count() == jobs.dedup(events).count()
    states = streamed(streaming.status(stream()), spark, tmp_path, "states", "update")
    assert {tuple(r) for r in states.collect()} == {tuple(r) for r in jobs.status(events).collect()}
    windows = streamed(streaming.rate_windows(stream(), 3600), spark, tmp_path, "windows", "complete")
    assert {tuple(r) for r in windows.collect()} == {tuple(r) for r in jobs.rate_windows(events, 3600).collect()}
