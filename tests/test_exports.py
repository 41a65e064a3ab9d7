"""Whole export documents: they parse, at any number of files, and hold what their venues hold."""

import csv
import io
import json
import os
import xml.etree.ElementTree as ET
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mezze.operators import enrich, export
from mezze.plans import pipeline_queries

AT = "2024-02-01T00:00:00.000Z"


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return pipeline_queries._exported(spark, sf_dir).cache()


def joined(path):
    parts = sorted(n for n in os.listdir(path) if n.startswith("part-"))
    return len(parts), "".join(open(f"{path}/{n}", encoding="utf-8").read() for n in parts)


def order(rows):
    return [r["id"] for r in sorted(rows.select("id", "updated_at").collect(), key=lambda r: r["id"])]


def written(spark, rows, kind, path, files=7):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(files))
    try:
        export.write_document(export.document(rows, kind, AT), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    return joined(path)


def last_updated_first(rows):
    return [r["id"] for r in sorted(rows.select("id", "updated_at").collect(), key=lambda r: (-r["updated_at"].timestamp(), r["id"]))]


@pytest.mark.parametrize("kind", ["json", "xml", "csv"])
def test_parts_in_order_are_one_document(spark, rows, tmp_path, kind):
    files, text = written(spark, rows, kind, str(tmp_path / kind))
    assert files > 3
    want = last_updated_first(rows)
    if kind == "json":
        whole = json.loads(text)
        assert whole["status"] == "success" and whole["generated_at"] == AT and whole["count"] == len(want)
        assert [v["id"] for v in whole["venues"]] == want
    elif kind == "xml":
        root = ET.fromstring(text)
        assert root.get("count") == str(len(want)) and root.get("generated_at") == AT
        assert [v.get("id") for v in root] == want
    else:
        assert text.startswith("﻿id,")
        table = list(csv.DictReader(io.StringIO(text.removeprefix("﻿"), newline="")))
        assert [v["id"] for v in table] == want


@pytest.mark.parametrize("kind", ["json", "xml", "csv"])
def test_documents_of_one_and_of_none(spark, rows, tmp_path, kind):
    for n in (0, 1):
        _, text = written(spark, rows.limit(n), kind, str(tmp_path / f"{kind}{n}"))
        found = json.loads(text)["venues"] if kind == "json" else ET.fromstring(text) if kind == "xml" else text.splitlines()[1:]
        assert len(found) == n


def test_documents_hold_the_same(rows):
    documents = {r["id"]: json.loads(r["json"]) for r in export.json_lines(rows, cdn="https://cdn.example").collect()}
    elements = {r["id"]: ET.fromstring(r["xml"]) for r in export.xml_elements(rows).collect()}
    lines = {r["id"]: dict(zip(export.CSV_COLUMNS, next(csv.reader(io.StringIO(r["line"], newline=""))))) for r in export.csv_lines(rows).collect()}
    for k, doc in documents.items():
        e, line = elements[k], lines[k]
        assert e.find("name").text == doc["name"] == line["name"]
        assert (doc["location"] is None) == ("lat" not in e.find("location").attrib) == (line["latitude"] == "")
        if doc["location"]:
            assert float(e.find("location").get("lat")) == doc["location"]["latitude"] == float(line["latitude"])
            assert "E" not in e.find("location").get("lng") + line["longitude"]
        assert line["instagram"] == doc["contacts"].get("social_media", {}).get("instagram", "") == (e.findtext("contacts/social") or "")
        assert line["categories"].split(" | ") == doc.get("categories", [""]) and [c.text for c in e.findall("categories/category")] == doc.get("categories", [])
        assert line["postal_code"] == doc["address"].get("postal_code", "") and line["plus_code"] == doc.get("plus_code", "") == (e.findtext("plus_code") or "")
        assert [d.text for d in e.findall("opening_hours/day")] == doc["opening_hours"].get("weekday_text", [])
        assert [(c.get("name"), c.text) for c in e.findall("digital_presence/ordering_channel")] == [(c["name"], c["url"]) for c in doc["digital_presence"]["ordering_channels"]]
        items = [i for c in doc["menu"]["categories"] for i in c["items"]]
        nodes = e.findall("menu/category/item")
        assert len(items) == len(nodes) == int(line["menu_items"])
        for i, n in zip(items, nodes):
            assert n.get("id") == i["item_id"] and n.findtext("description") == i.get("description") and n.findtext("is_available") == str(i["is_available"]).lower()
            assert [a.text for a in n.findall("allergen")] == i["allergens"] and len(n.findall("variant")) == len(i["variants"])
            assert ("webp_image_url" in i) == (n.find("image_webp") is not None) and i.get("webp_image_url", "https://cdn.example/media/").startswith("https://cdn.example/media/")


def test_numbers_as_javascript_prints_them(spark):
    said = {0.0: "0", -0.0: "0", 4.0: "4", 0.0005: "0.0005", 12345678.5: "12345678.5", -3.25: "-3.25", 1e-7: "1e-7", 2.5e-9: "2.5e-9", 1e21: "1e+21", 123456789012345680000.0: "123456789012345680000", 1e15: "1000000000000000", 0.1: "0.1", 43.516999999999996: "43.516999999999996", 1.5e300: "1.5e+300"}
    got = spark.createDataFrame([(x,) for x in said], "x double").select("x", export.number(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in got] == list(said.values())
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS x").select(export.number(F.col("x"))).first()[0] is None
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS x").select(export.money(F.col("x"))).first()[0] == "0.00"


def test_listing_holds_its_limit(spark, rows):
    assert export.listing(rows, 0).count() == 1 and export.listing(rows, -5).count() == 1 and export.listing(rows, 3.9).count() == 3
    assert export.listing(rows, float("nan")).count() == export.listing(rows, None).count() == min(1000, rows.count())
    many = spark.range(6000).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("timestamp").alias("updated_at"))
    assert export.listing(many, 1e9).count() == 5000
    assert [r["id"] for r in export.listing(rows, 20).collect()] == last_updated_first(rows)[:20]


def test_send_says_what_it_wrote(spark, rows, tmp_path):
    kind, name = export.send(rows, "xml", str(tmp_path / "x"), AT, limit=5)
    assert (kind, name) == ("application/xml; charset=utf-8", "venue_export_2024-02-01.xml")
    assert len(ET.fromstring(joined(str(tmp_path / "x"))[1])) == 5
    with pytest.raises(ValueError, match="Unsupported format"):
        export.document(rows, "yaml", AT)


def test_control_characters_leave_xml_sound(rows):
    odd = rows.limit(3).withColumn("name", F.lit("a\x00\x0b<b>&\"'￾퟿\U0001f355"))
    for r in export.xml_elements(odd).collect():
        assert ET.fromstring(r["xml"]).findtext("name") == "a<b>&\"'퟿\U0001f355"


def test_upsert_orders_rows_without_a_time(spark):
    schema = "google_place_id string, name string, created_at timestamp, updated_at timestamp"
    day = lambda n: datetime(2024, 1, n)
    stored = spark.createDataFrame([("a", "old", day(1), day(1)), ("b", "old", day(1), day(1)), (None, "old", None, None)], schema)
    incoming = [("a", "x", day(9), None), ("c", "new", day(2), None), ("c", "newer", day(2), None), ("b", "x", None, None), ("b", "timed", None, day(2)), ("b", "tie", None, day(2)), (None, "none", None, None)]
    for rows in (incoming, incoming[::-1]):
        got = {r["google_place_id"]: tuple(r)[1:] for r in enrich.upsert(stored, spark.createDataFrame(rows, schema)).collect()}
        assert got == {"a": ("x", day(1), None), "b": ("timed", day(1), day(2)) if "timed" > "tie" else ("tie", day(1), day(2)), "c": ("newer", day(2), None), None: ("none", None, None)}
