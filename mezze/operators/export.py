"""Exports of venue documents as JSON, XML and CSV; the menu comes along as a column `categories` of nested items.

Fields that a table of venues does not have are left out of its documents, as are fields without a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mezze.operators.menus import item_count

CSV_COLUMNS = (
    "id", "google_place_id", "name", "primary_type", "rating", "user_ratings_total", "latitude", "longitude", "city", "district", "address", "phones", "emails", "website", "instagram", "has_website", "has_qr_menu",
    "qr_menu_provider", "qr_menu_url", "supports_online_ordering", "menu_categories", "menu_items", "data_source", "provider", "categories", "plus_code", "postal_code", "opening_hours",
)
BOM = "﻿"
MOST, USUAL = 5000, 1000
#: Content type and ending of each format.
FORMATS = {"json": ("application/json; charset=utf-8", "json"), "xml": ("application/xml; charset=utf-8", "xml"), "csv": ("text/csv; charset=utf-8", "csv")}


def number(x: Column) -> Column:
    """A number as JavaScript prints it: no decimals if it has none, an exponent only below 1e-6 and from 1e21 on."""
    said = x.cast("double").cast("string")
    plain = F.rtrim(F.rtrim(said.try_cast("decimal(38,22)").cast("string"), F.lit("0")), F.lit("."))
    whole = F.coalesce(said.try_cast("decimal(38,0)").cast("string"), said)
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(said, r"\.0E", "E"), "E-", "e-"), "E", "e+")
    size = F.abs(x.cast("double"))
    return F.when(size == 0, F.lit("0")).when((size < 1e-6) | (size >= 1e21), power).when(size >= 1e15, whole).otherwise(F.coalesce(plain, said))


def money(x: Column) -> Column:
    """Two decimals; no value is nothing to pay."""
    return F.format_string("%.2f", F.coalesce(x.cast("double"), F.lit(0.0)))


def _kind(kind: T.DataType, path: str) -> T.DataType | None:
    """The type at a path of fields, through arrays; None if there is none."""
    for name in path.split(".") if path else ():
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def _at(venues: DataFrame, path: str, otherwise: str = "string") -> Column:
    """The column at a path, a null of the type `otherwise` where the table does not have it."""
    return F.col(path) if _kind(venues.schema, path) is not None else F.lit(None).cast(otherwise)


def listing(venues: DataFrame, limit: float | None = USUAL) -> DataFrame:
    """The venues of an export: last updated first, then by id, at most `limit` of them, which is held within 1 and 5000."""
    most = USUAL if limit is None or limit != limit else int(min(MOST, max(1, limit)))
    return venues.orderBy(F.col("updated_at").desc_nulls_last(), "id").limit(most)


def csv_header() -> str:
    return BOM + ",".join(CSV_COLUMNS)


def csv_line(venues: DataFrame) -> Column:
    """28 columns; a value is quoted only if it has a quote, comma, line end or semicolon; lists by ` | `."""
    at = lambda path, kind="string": _at(venues, path, kind)
    listed = lambda path: F.array_join(F.coalesce(at(path, "array<string>"), F.array().cast("array<string>")), " | ")
    flag = lambda c: F.col(f"digital_presence.{c}").cast("string")
    menu = F.col("categories")
    values = {
        "id": F.col("id"), "google_place_id": F.col("google_place_id"), "name": F.col("name"), "primary_type": F.col("primary_type"), "rating": number(F.col("rating")), "user_ratings_total": F.col("user_ratings_total").cast("string"),
        "latitude": number(F.col("location.coordinates")[1]), "longitude": number(F.col("location.coordinates")[0]), "city": F.col("address.city"), "district": F.col("address.district"), "address": F.col("address.formatted"),
        "phones": listed("contacts.phone_numbers"), "emails": listed("contacts.emails"), "website": F.col("contacts.website_url"), "instagram": F.try_element_at(at("contacts.social_media", "map<string,string>"), F.lit("instagram")),
        "has_website": flag("has_website"), "has_qr_menu": flag("has_qr_menu"), "qr_menu_provider": F.col("digital_presence.qr_menu_provider"), "qr_menu_url": F.col("digital_presence.qr_menu_url"), "supports_online_ordering": flag("supports_online_ordering"),
        "menu_categories": F.when(menu.isNull(), 0).otherwise(F.size(menu)).cast("string"), "menu_items": F.coalesce(item_count(menu), F.lit(0)).cast("string"), "data_source": F.col("data_source"), "provider": F.col("provider"),
        "categories": listed("kinds"), "plus_code": at("plus_code"), "postal_code": at("address.postal_code"), "opening_hours": listed("opening_hours.weekday_text"),
    }
    quoted = lambda v: F.when(F.regexp_like(v, F.lit('[",\n;]')), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    cells = [quoted(F.coalesce(values[c], F.lit(""))) for c in CSV_COLUMNS]
    return F.concat_ws(",", *cells)


def csv_lines(venues: DataFrame) -> DataFrame:
    """id, line: see `csv_line`."""
    return venues.select("id", csv_line(venues).alias("line"))


def _items(venues: DataFrame, cdn: str) -> Column:
    """The menu's categories with the fields of an item that a document has; local images get the CDN's address."""
    kind = venues.schema["categories"].dataType
    names = _kind(kind, "items").elementType.names
    picture = "original_image_url" if "original_image_url" in names else "image"
    local = lambda u: F.when(F.length(u) > 0, F.when(u.startswith("/"), F.concat(F.lit(cdn), u)).otherwise(u))
    order = (("item_id", "item_id"), ("name", "name"), ("description", "description"), ("price", "price"), ("currency", "currency"), (picture, "original_image_url"), ("webp_image_url", "webp_image_url"), ("is_available", "is_available"), ("allergens", "allergens"), ("variants", "variants"))
    item = lambda i: F.struct(*[(local(i[c]) if c in ("image", "webp_image_url") else i[c]).alias(name) for c, name in order if c in names])
    some = F.coalesce(F.col("categories"), F.array().cast(kind.simpleString()))
    return F.transform(some, lambda c: F.struct(c["category_id"].alias("category_id"), c["name"].alias("name"), F.transform(c["items"], item).alias("items")))


def json_document(venues: DataFrame, cdn: str = "") -> Column:
    """One document a venue. The location is there as null if it is unknown; lists are empty rather than left out."""
    has = lambda path: _kind(venues.schema, path) is not None
    some = lambda path, *names: [F.col(f"{path}.{n}").alias(n) for n in names if has(f"{path}.{n}")]
    top = lambda *names: [F.col(n) for n in names if has(n)]
    flag = lambda n: F.coalesce(F.col(f"digital_presence.{n}"), F.lit(False)).alias(n)
    full = lambda path, name: [F.coalesce(F.col(f"{path}.{name}"), F.array().cast(_kind(venues.schema, f"{path}.{name}").simpleString())).alias(name)] if has(f"{path}.{name}") else []
    time = lambda c: [F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(c)] if has(c) else []
    point = F.col("location.coordinates")
    location = F.when(F.size(point) == 2, F.to_json(F.struct(F.lit("Point").alias("type"), point.alias("coordinates"), point[1].alias("latitude"), point[0].alias("longitude"))))
    head = F.struct(*top("id", "google_place_id", "name", "primary_type", "rating", "user_ratings_total", "price_level"))
    tail = F.struct(
        F.struct(*some("address", "formatted", "country", "city", "district", "neighborhood", "postal_code")).alias("address"),
        F.struct(*full("contacts", "phone_numbers"), *full("contacts", "emails"), *some("contacts", "website_url", "social_media")).alias("contacts"),
        F.struct(flag("has_website"), flag("has_qr_menu"), *some("digital_presence", "qr_menu_provider", "qr_menu_url"), flag("supports_online_ordering"), *full("digital_presence", "ordering_channels")).alias("digital_presence"),
        *top("photos"),
        F.struct(F.coalesce(_at(venues, "currency"), F.lit("TRY")).alias("currency"), *top("source_url", "extraction_method"), _items(venues, cdn).alias("categories")).alias("menu"),
        *[F.col("kinds").alias("categories") for _ in top("kinds")], *top("opening_hours", "plus_code", "source_ids", "data_source", "provider"), *time("created_at"), *time("updated_at"),
    )
    inner = lambda said: F.substring(said, F.lit(2), F.length(said) - 2)
    parts = (inner(F.to_json(head)), F.concat(F.lit('"location":'), F.coalesce(location, F.lit("null"))), inner(F.to_json(tail)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_lines(venues: DataFrame, cdn: str = "") -> DataFrame:
    """id, json: see `json_document`."""
    return venues.select("id", json_document(venues, cdn).alias("json"))


def _escaped(x: Column) -> Column:
    """A text as XML has it; control characters that XML cannot hold are left out."""
    x = F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(char), F.lit(entity))
    return x


def _node(name: str, text: Column, attributes: dict[str, Column] | None = None) -> Column:
    """An element; null if its text is. An attribute without a value is left out."""
    given = [F.coalesce(F.concat(F.lit(f' {k}="'), _escaped(v), F.lit('"')), F.lit("")) for k, v in (attributes or {}).items()]
    return F.concat(F.lit(f"<{name}"), *given, F.lit(">"), text, F.lit(f"</{name}>"))


def xml_element(venues: DataFrame) -> Column:
    """One `venue` element each, nodes in a fixed order, prices with two decimals; optional nodes only with a value."""
    kind = venues.schema
    item_has = _kind(kind["categories"].dataType, "items").elementType.names
    always = lambda n, c, of=None: _node(n, _escaped(F.coalesce(c, F.lit(""))), of)
    maybe = lambda n, c: _node(n, _escaped(F.nullif(c, F.lit(""))))
    joined = lambda *parts: F.concat_ws("", *parts)
    each = lambda a, f: F.array_join(F.transform(a, f), "")
    around = lambda n, inner: F.when(inner != "", _node(n, inner))
    where = joined(maybe("address", F.col("address.formatted")), always("city", F.col("address.city")), always("district", F.col("address.district")), maybe("country", F.col("address.country")))
    point = F.col("location.coordinates")
    location = _node("location", where, {"lat": number(point[1]), "lng": number(point[0])})
    social = F.map_entries(_at(venues, "contacts.social_media", "map<string,string>"))
    contacts = joined(
        each("contacts.emails", lambda e: always("email", e)), each("contacts.phone_numbers", lambda p: always("phone", p)), maybe("website", F.col("contacts.website_url")),
        each(F.filter(social, lambda s: F.length(s["value"]) > 0), lambda s: always("social", s["value"], {"platform": s["key"]})),
    )
    d = lambda n: F.col(f"digital_presence.{n}")
    flag = lambda n: F.coalesce(d(n), F.lit(False)).cast("string")
    channels = _at(venues, "digital_presence.ordering_channels", "array<struct<name:string,url:string>>")
    presence = joined(
        always("has_website", flag("has_website")), always("has_qr_menu", flag("has_qr_menu")), always("qr_provider", d("qr_menu_provider")), maybe("qr_menu_url", d("qr_menu_url")), always("supports_online_ordering", flag("supports_online_ordering")),
        each(channels, lambda c: always("ordering_channel", c["url"], {"name": F.coalesce(c["name"], F.lit(""))})),
    )
    of = lambda i, name, make: [make(i[name])] if name in item_has else []
    item = lambda i: _node(
        "item",
        joined(
            always("name", i["name"]), *of(i, "description", lambda x: maybe("description", x)), always("price", money(i["price"])), *of(i, "allergens", lambda a: each(a, lambda x: always("allergen", x))),
            *of(i, "variants", lambda a: each(a, lambda v: always("variant", money(v["price"]), {"name": v["name"]}))), *of(i, "webp_image_url", lambda x: maybe("image_webp", x)),
            always("is_available", (F.coalesce(i["is_available"], F.lit(True)) if "is_available" in item_has else F.lit(True)).cast("string")),
        ),
        {"id": i["item_id"]},
    )
    category = lambda c: _node("category", F.coalesce(each(c["items"], item), F.lit("")), {"name": c["name"], "id": c["category_id"]})
    body = joined(
        always("google_place_id", F.col("google_place_id")), always("name", F.col("name")), always("primary_type", F.col("primary_type")), maybe("rating", number(F.col("rating"))), location,
        _node("contacts", contacts), _node("digital_presence", presence),
        around("categories", F.coalesce(each(_at(venues, "kinds", "array<string>"), lambda k: always("category", k)), F.lit(""))),
        around("opening_hours", F.coalesce(each(_at(venues, "opening_hours.weekday_text", "array<string>"), lambda h: always("day", h)), F.lit(""))),
        maybe("plus_code", _at(venues, "plus_code")), maybe("data_source", F.col("data_source")),
        _node("menu", F.coalesce(each("categories", category), F.lit("")), {"currency": F.coalesce(_at(venues, "currency"), F.lit("TRY"))}),
    )
    return _node("venue", body, {"id": F.col("id")})


def xml_elements(venues: DataFrame) -> DataFrame:
    """id, xml: see `xml_element`."""
    return venues.select("id", xml_element(venues).alias("xml"))


def document(venues: DataFrame, format: str, generated_at: str, cdn: str = "", root: str = "venue_export") -> DataFrame:
    """section, updated_at, id, line: a whole export as lines, in order by section, last updated first, then id.

    JSON has {status, generated_at, count, venues}, XML a root element with generated_at and count, CSV a line of headings.
    The heading needs the number of venues and the separators which of them is the first: one aggregation gives both, so
    no documents are gathered anywhere. ids are unique and not null; venues without updated_at come last.
    """
    if format not in FORMATS:
        raise ValueError(f'Unsupported format "{format}". Use json, xml or csv.')
    line = {"json": lambda: json_document(venues, cdn), "xml": lambda: xml_element(venues), "csv": lambda: csv_line(venues)}[format]()
    age = F.struct(F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(1 << 62))) * -1, F.col("id"))
    whole = venues.agg(F.count("*").alias("count"), F.min_by("id", age).alias("first"))
    count = F.col("count").cast("string")
    heading = {
        "json": F.concat(F.lit(f'{{"status":"success","generated_at":"{generated_at}","count":'), count, F.lit(',"venues":[')),
        "xml": F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><{root} generated_at="{generated_at}" count="'), count, F.lit('">')),
        "csv": F.lit(csv_header()),
    }[format]
    end = {"json": "]}", "xml": f"</{root}>", "csv": None}[format]
    no_time = F.lit(None).cast(dict(venues.dtypes)["updated_at"]).alias("updated_at")
    around = whole.select(F.explode(F.array(F.struct(F.lit(0).alias("section"), heading.alias("line")), *([F.struct(F.lit(2).alias("section"), F.lit(end).alias("line"))] if end else []))).alias("x")).select("x.section", no_time, F.lit("").alias("id"), "x.line")
    said = venues.select(F.lit(1).alias("section"), "updated_at", "id", line.alias("line"))
    if format == "json":
        # One row: which document has no comma before it.
        said = said.join(F.broadcast(whole.select(F.col("first").alias("_first")))).withColumn("line", F.when(F.col("id") == F.col("_first"), F.col("line")).otherwise(F.concat(F.lit(","), F.col("line")))).drop("_first")
    return around.unionByName(said)


def write_document(lines: DataFrame, path: str) -> None:
    """The lines of `document` as text files: one after the other, in the order of their names, they are the document.

    Spark sorts by range, so each file is a run of the order, and files may be written by as many tasks as it takes.
    """
    lines.orderBy("section", F.col("updated_at").desc_nulls_last(), "id").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def send(venues: DataFrame, format: str, path: str, generated_at: str, limit: float | None = USUAL, **how) -> tuple[str, str]:
    """Writes the export of the listing, and returns its content type and file name."""
    write_document(document(listing(venues, limit), format, generated_at, **how), path)
    kind, ending = FORMATS[format]
    return kind, f"venue_export_{generated_at[:10]}.{ending}"


def write_text(lines: DataFrame, column: str, path: str, order: str = "id") -> None:
    """Lines in order, as text files: one after the other they are the export's body."""
    lines.orderBy(order).select(F.col(column).alias("value")).write.mode("overwrite").text(path)
