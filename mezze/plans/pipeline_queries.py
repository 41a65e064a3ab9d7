"""Queries over providers, enrichment, upserts, exports and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from mezze.operators import enrich as ops
from mezze.operators import export, jobs
from mezze.operators.menus import merge_pages, nested
from mezze.plans.views import JOBS, MENU_ROWS, VENUES, job_events, menu_rows, menu_tasks, table, venues

_V = f"WITH {VENUES}"
JOBS_SQL = _J = f"WITH {JOBS}"


def _rows_a(s, d):
    """Suppliers as JSON rows of the first hosted source."""
    k = F.col("s_suppkey")
    text = k.cast("string")
    row = F.struct(
        F.when(k % 3 == 0, F.concat(F.lit("pl_"), text)).alias("place_id"), F.when(k % 3 == 1, F.concat(F.lit("g_"), text)).alias("google_id"), F.when(k % 5 != 0, F.concat(F.lit("c_"), text)).alias("cid"), F.when(k % 11 != 0, F.col("s_name")).alias("name"),
        F.concat(F.lit("Street "), text, F.lit(", 34714 District"), text, F.lit("/City"), (k % 4).cast("string")).alias("full_address"), F.when(k % 2 == 0, "Given").alias("city"), (k % 50).cast("int").alias("reviews"), F.when(k % 4 == 0, "https://s.example").alias("site"), F.when(k % 7 == 0, "bar, cafe").alias("subtypes"),
    )
    return table(s, d, "supplier").select(F.to_json(row).alias("json"))


_ROWS_A = """WITH r AS (SELECT s_suppkey AS k, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'pl_' || s_suppkey END, CASE WHEN s_suppkey % 3 = 1 THEN 'g_' || s_suppkey END, CASE WHEN s_suppkey % 5 <> 0 THEN 'c_' || s_suppkey END) AS place_id, CASE WHEN s_suppkey % 11 <> 0 THEN s_name END AS name FROM supplier)
SELECT place_id, name, CASE WHEN k % 2 = 0 THEN 'Given' ELSE 'City' || k % 4 END AS city, 'District' || k AS district, '34714' AS postal_code, (k % 50)::INTEGER AS user_ratings_total, CASE WHEN k % 4 = 0 THEN 'https://s.example' END AS website, CASE WHEN k % 7 = 0 THEN 'bar|cafe' ELSE 'restaurant' END AS types
FROM r WHERE place_id IS NOT NULL AND name IS NOT NULL"""


def _normal_a(s, d):
    return ops.normalize_a(_rows_a(s, d)).select("place_id", "name", "address_parts.city", "address_parts.district", "address_parts.postal_code", "user_ratings_total", "website", F.array_join("types", "|").alias("types"))


def _normal_b(s, d):
    k = F.col("s_suppkey")
    row = F.struct(
        F.when(k % 2 == 0, F.concat(F.lit("B"), k.cast("string"))).alias("placeId"), F.concat(F.lit("f"), k.cast("string")).alias("fid"), F.col("s_name").alias("title"), F.lit("A, B/C").alias("address"), F.when(k % 3 != 0, F.struct((k % 90).cast("double").alias("lat"), F.lit(29.5).alias("lng"))).alias("location"),
        F.when(k % 4 == 0, "Hood").alias("neighborhood"), F.when(k % 5 == 0, F.array(F.lit("bar"))).alias("categories"), F.array(F.struct(F.lit("Mon").alias("day"), F.lit("9-5").alias("hours"))).alias("openingHours"),
    )
    return ops.normalize_b(table(s, d, "supplier").select(F.to_json(row).alias("json"))).select("place_id", "name", "lat", "lng", "address_parts.city", "address_parts.district", F.array_join("types", "|").alias("types"), F.array_join("weekday_text", "|").alias("hours"))


_ROWS_B = """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'B' ELSE 'f' END || s_suppkey AS place_id, s_name AS name, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 90)::DOUBLE END AS lat, CASE WHEN s_suppkey % 3 <> 0 THEN 29.5e0 END AS lng, 'C' AS city,
CASE WHEN s_suppkey % 4 = 0 THEN 'Hood' ELSE 'B' END AS district, CASE WHEN s_suppkey % 5 = 0 THEN 'bar' ELSE 'restaurant' END AS types, 'Mon: 9-5' AS hours FROM supplier"""


def _attempts(s, d):
    k, r = F.col("o_orderkey"), F.col("rank")
    tries = table(s, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rank"))
    return tries.select(k.alias("request_id"), "rank", F.concat(F.lit("p"), (r % 3).cast("string")).alias("provider"), ((k + r) % 5 != 0).alias("configured"), ((k * (r + 3)) % 4 == 1).alias("ok"))


_ATTEMPTS = """WITH t AS (SELECT o_orderkey AS request_id, r AS rank, 'p' || r % 3 AS provider, (o_orderkey * (r + 3)) % 4 = 1 AS ok FROM orders, range(0, 4) g(r) WHERE (o_orderkey + r) % 5 <> 0),
u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY request_id, provider ORDER BY rank) = 1), f AS (SELECT request_id, min(rank) FILTER (ok) AS first, min_by(provider, rank) FILTER (ok) AS provider FROM u GROUP BY 1)
SELECT u.request_id, any_value(f.provider) AS provider, count(*) FILTER (first IS NULL OR rank <= first) AS n_attempts, bool_and(first IS NULL) AS blocked FROM u JOIN f USING (request_id) GROUP BY 1"""


def _places(s, d):
    """Provider rows of the venues, some without a point, a name or a site."""
    k = F.col("id").cast("long")
    v = venues(s, d)
    return v.select(F.col("google_place_id").alias("place_id"), F.when(k % 9 != 0, F.col("name")).otherwise("").alias("name"), F.when(k % 5 != 0, F.col("location.coordinates")[1]).alias("lat"), F.when(k % 5 != 0, F.col("location.coordinates")[0]).alias("lng"), F.get("contacts.phone_numbers", F.lit(0)).alias("phone"), F.col("contacts.website_url").alias("website"), k.alias("k"), F.col("contacts.emails").alias("mails"))


def _enriched(s, d):
    p, k = _places(s, d), F.col("k")
    scans = p.filter(k % 2 == 0).select("place_id", F.concat(F.lit("Site "), k.cast("string")).alias("site_name"), F.col("mails").alias("emails"), F.array(F.lit("+902121112233")).alias("phones"), F.when(k % 10 == 0, 40.5).alias("site_lat"), F.when(k % 10 == 0, 29.5).alias("site_lng"), F.when(k % 4 == 0, "https://qr.example").alias("qr_menu_url"))
    points = p.filter(k % 7 != 0).select("place_id", F.when(k % 3 == 0, 0.001).otherwise(39.0).alias("geo_lat"), F.when(k % 3 == 0, 0.002).otherwise(33.0).alias("geo_lng"))
    return ops.enrich(p.drop("k", "mails"), scans, points)


_ENRICHED = f"""{_V}, e AS (
  SELECT google_place_id, CASE WHEN k % 9 <> 0 THEN name WHEN k % 2 = 0 THEN 'Site ' || k END AS name,
    CASE WHEN k % 5 <> 0 AND lat IS NOT NULL THEN lat WHEN k % 10 = 0 THEN 40.5e0 WHEN k % 7 <> 0 AND k % 3 <> 0 THEN 39e0 END AS lat, CASE WHEN k % 5 <> 0 AND lng IS NOT NULL THEN lng WHEN k % 10 = 0 THEN 29.5e0 WHEN k % 7 <> 0 AND k % 3 <> 0 THEN 33e0 END AS lng,
    CASE WHEN k % 5 <> 0 AND lat IS NOT NULL THEN 'provider' WHEN k % 10 = 0 THEN 'page' WHEN k % 7 <> 0 AND k % 3 <> 0 THEN 'geocoder' END AS point_source,
    list_concat(list_transform(phone_numbers, lambda p: '+90' || substr(p, 2)), CASE WHEN k % 2 = 0 THEN ['+902121112233'] ELSE [] END) AS phone_numbers, CASE WHEN k % 2 = 0 THEN emails ELSE [] END AS emails,
    website_url, CASE WHEN k % 4 = 0 THEN 'https://qr.example' ELSE website_url END AS menu_url FROM venues
)"""
_FLAT = lambda df: df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def _details(s, d):
    p = _places(s, d).drop("k", "mails")
    details = p.filter(F.substring("place_id", 3, 9).cast("long") % 4 == 0).select("place_id", F.lit("Detail").alias("name"), F.lit(None).cast("string").alias("phone"))
    return ops.fill_details(p, details, ["name", "phone"]).select("place_id", "name", "phone")


def _geocoded(s, d):
    k = F.col("id").cast("long")
    candidates = ops.geocode_candidates(F.concat(F.col("address.formatted"), F.lit(" (St)")), F.lit(""), F.when(k % 2 == 0, F.col("address.district")), F.col("address.city"))
    p = venues(s, d).select(F.col("google_place_id").alias("place_id"), candidates.alias("candidates"))
    cities = table(s, d, "nation").select(F.col("n_name").alias("query"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(30.0).alias("lng"))
    exact = table(s, d, "nation").select(F.concat(F.lit("d2, "), F.col("n_name")).alias("query"), F.when(F.col("n_nationkey") % 2 == 0, 95.0).otherwise(41.0).alias("lat"), F.lit(29.0).alias("lng"))
    return ops.geocode(p, cities.unionByName(exact))


def _upserted(s, d):
    v = venues(s, d).select("google_place_id", "name", "rating", "data_source", "created_at", "updated_at", F.col("id").cast("long").alias("k"))
    stored = v.filter("k % 3 <> 0").drop("k")
    twice = v.filter("k % 2 = 0").select("google_place_id", F.concat("name", F.lit(" new")).alias("name"), F.when(F.col("k") % 4 == 0, F.col("rating")).alias("rating"), F.lit(None).cast("timestamp").alias("created_at"), (F.col("updated_at") + F.make_dt_interval(days=F.lit(1))).alias("updated_at"))
    older = twice.withColumn("name", F.lit("older")).withColumn("updated_at", F.col("updated_at") - F.make_dt_interval(hours=F.lit(1)))
    return ops.upsert(stored, twice.unionByName(older))


def _upserted_nulls(s, d):
    """Updates without a time, among them new keys, and several of one key and time."""
    v = venues(s, d).select("google_place_id", "name", "updated_at", F.col("id").cast("long").alias("k"))
    timeless = v.filter("k % 2 = 0").select(F.when(F.col("k") % 8 == 0, F.concat(F.lit("new"), "google_place_id")).otherwise(F.col("google_place_id")).alias("google_place_id"), F.concat("name", F.lit(" b")).alias("name"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    tied = timeless.withColumn("name", F.concat("name", F.lit(" c")))
    timed = v.filter("k % 6 = 0 AND k % 8 <> 0").select("google_place_id", F.lit("timed").alias("name"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))
    return ops.upsert(v.drop("k").withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz")), timeless.unionByName(tied).unionByName(timed))


_UPSERT_NULLS = f"""{_V} SELECT google_place_id, CASE WHEN k % 2 = 0 AND k % 8 <> 0 THEN CASE WHEN k % 6 = 0 THEN 'timed' ELSE name || ' b c' END ELSE name END AS name, CASE WHEN k % 2 <> 0 OR k % 8 = 0 OR k % 6 = 0 THEN updated_at END AS updated_at FROM venues
UNION ALL SELECT 'new' || google_place_id, name || ' b c', NULL FROM venues WHERE k % 8 = 0"""


def _exported(s, d):
    """Venues as an export has them, all optional fields included, some of them empty, with odd characters and numbers."""
    tasks = menu_tasks(s, d)
    k, menu = F.col("id").cast("long"), nested(merge_pages(menu_rows(s, d, tasks), tasks), tasks)
    odd = F.length("name")
    text = "array<string>"
    full = lambda i: F.struct(
        i["item_id"].alias("item_id"), i["name"].alias("name"), F.when(F.length(i["name"]) % 2 == 0, F.concat(F.lit('"Hot" & <'), i["name"], F.lit(">"))).alias("description"), i["price"].alias("price"), F.lit("TRY").alias("currency"), i["image"].alias("original_image_url"),
        F.when(i["image"].isNotNull(), F.concat(F.lit("/media/"), i["item_id"], F.lit(".webp"))).alias("webp_image_url"), (F.length(i["name"]) % 3 != 0).alias("is_available"), F.when(i["price"] > 1500, F.array(F.lit("nuts"), F.lit("milk"))).otherwise(F.array().cast(text)).alias("allergens"),
        F.array(F.struct(F.lit("Half").alias("name"), (i["price"] / 2).alias("price"))).alias("variants"),
    )
    menus = menu.select(F.col("venue_id").alias("m_id"), F.transform("categories", lambda c: F.struct(c["category_id"].alias("category_id"), c["name"].alias("name"), F.transform(c["items"], full).alias("items"))).alias("categories"))
    wide = venues(s, d).join(menus, F.col("id") == F.col("m_id"), "left").drop("m_id")
    small = F.struct(F.lit("Point").alias("type"), F.array(F.lit(0.0005), F.lit(-12.0)).alias("coordinates"))
    return wide.select(
        "id", "google_place_id", F.when(k % 10 == 0, F.concat("name", F.lit(' & "Söhne"; <1>, x'))).otherwise(F.col("name")).alias("name"), "primary_type", "rating", "user_ratings_total", F.when(k % 2 == 0, (k % 5).cast("int")).alias("price_level"),
        F.when(k % 17 == 0, small).otherwise(F.col("location")).alias("location"), F.struct("address.*", F.when(k % 3 == 0, F.lpad((k % 90000).cast("string"), 5, "0")).alias("postal_code")).alias("address"),
        F.struct("contacts.*", F.when(k % 4 == 0, F.create_map(F.lit("instagram"), F.concat(F.lit("https://instagram.com/v"), "id"))).alias("social_media")).alias("contacts"),
        F.struct("digital_presence.*", F.when(k % 5 == 0, F.array(F.struct(F.lit("Getir").alias("name"), F.concat(F.lit("https://g.example/?a=1&v="), "id").alias("url")))).alias("ordering_channels")).alias("digital_presence"),
        "categories", F.when(k % 6 == 0, F.array(F.lit("cafe"), F.col("primary_type"))).alias("kinds"), F.struct(F.when(k % 7 == 0, F.array(F.lit("Mon: 9-5"), F.lit("Tue: closed"))).alias("weekday_text")).alias("opening_hours"), F.when(k % 8 == 0, F.concat(F.lit("8GC2+"), "id")).alias("plus_code"),
        "data_source", "provider", "created_at", "updated_at",
    )


_NUMBER = "CASE WHEN {x} = floor({x}) THEN CAST({x}::BIGINT AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
_CELL = """CASE WHEN regexp_matches({x}, '[",\n;]') THEN '"' || replace({x}, '"', '""') || '"' ELSE coalesce({x}, '') END"""
_XML = "replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
#: The venues of `_exported`, and their merged menus in order.
_WIDE = f"""{_V}, {MENU_ROWS}, merged AS (
  SELECT * FROM menu_rows QUALIFY row_number() OVER (PARTITION BY venue_id, trim(regexp_replace(lower(category), '\\s+', ' ', 'g')), lower(name), price ORDER BY ord) = 1
), items AS (
  SELECT *, 'item_' || substr(md5(concat_ws(':', category, name)), 1, 8) AS item_id, 'cat_' || substr(md5(category), 1, 8) AS category_id, min(ord) OVER (PARTITION BY venue_id, category) AS cat_ord,
    CASE WHEN length(name) % 2 = 0 THEN '"Hot" & <' || name || '>' END AS description, length(name) % 3 <> 0 AS is_available, price > 1500 AS allergic FROM merged
), wide AS (
  SELECT venues.* REPLACE (CASE WHEN k % 10 = 0 THEN name || ' & "Söhne"; <1>, x' ELSE name END AS name, CASE WHEN k % 17 = 0 THEN 0.0005e0 ELSE lng END AS lng, CASE WHEN k % 17 = 0 THEN -12e0 ELSE lat END AS lat),
    CASE WHEN k % 2 = 0 THEN k % 5 END AS price_level, CASE WHEN k % 3 = 0 THEN lpad(CAST(k % 90000 AS VARCHAR), 5, '0') END AS postal_code, CASE WHEN k % 4 = 0 THEN 'https://instagram.com/v' || id END AS instagram,
    CASE WHEN k % 5 = 0 THEN 'https://g.example/?a=1&v=' || id END AS channel, CASE WHEN k % 6 = 0 THEN ['cafe', primary_type] END AS kinds, CASE WHEN k % 7 = 0 THEN ['Mon: 9-5', 'Tue: closed'] END AS hours, CASE WHEN k % 8 = 0 THEN '8GC2+' || id END AS plus_code,
    CASE WHEN has_qr_menu AND k % 4 = 0 THEN qr_menu_url END AS qr_url
  FROM venues
)"""
_CELLS = ["id", "google_place_id", "name", "primary_type", _NUMBER.format(x="rating"), "CAST(user_ratings_total AS VARCHAR)", "CASE WHEN lat = 0.0005e0 THEN '0.0005' ELSE " + _NUMBER.format(x="lat") + " END", "CASE WHEN lng = 0.0005e0 THEN '0.0005' ELSE " + _NUMBER.format(x="lng") + " END", "city", "district", "formatted",
          "array_to_string(phone_numbers, ' | ')", "array_to_string(emails, ' | ')", "website_url", "instagram", "CAST(has_website AS VARCHAR)", "CAST(has_qr_menu AS VARCHAR)", "qr_menu_provider", "qr_url", "CAST(supports_online_ordering AS VARCHAR)",
          "CAST(coalesce(c, 0) AS VARCHAR)", "CAST(coalesce(i, 0) AS VARCHAR)", "data_source", "provider", "array_to_string(kinds, ' | ')", "plus_code", "postal_code", "array_to_string(hours, ' | ')"]
_CSV = f"""{_WIDE}, n AS (SELECT venue_id, count(DISTINCT category) AS c, count(*) AS i FROM items GROUP BY 1)
SELECT id, {" || ',' || ".join(_CELL.format(x=f"({c})") for c in _CELLS)} AS line FROM wide LEFT JOIN n ON id = venue_id"""


def _json_field(name: str, value: str, text: bool = True) -> str:
    """A member of an object with its comma after it; nothing where the value is null."""
    return f"""coalesce('"{name}":' || {f"to_json({value})" if text else value} || ',', '')"""


def _json_object(*fields: str) -> str:
    return "'{' || rtrim(" + " || ".join(fields) + ", ',') || '}'"


_f = _json_field
_ITEM = _json_object(
    _f("item_id", "item_id"), _f("name", "name"), _f("description", "description"), _f("price", "CAST(price AS VARCHAR)", False), _f("currency", "'TRY'"), _f("original_image_url", "image"), _f("webp_image_url", "CASE WHEN image IS NOT NULL THEN '/media/' || item_id || '.webp' END"),
    _f("is_available", "is_available"), _f("allergens", "CASE WHEN allergic THEN '[\"nuts\",\"milk\"]' ELSE '[]' END", False), _f("variants", "'[{\"name\":\"Half\",\"price\":' || CAST(price / 2 AS VARCHAR) || '}]'", False),
)
_DOCUMENT = _json_object(
    _f("id", "id"), _f("google_place_id", "google_place_id"), _f("name", "name"), _f("primary_type", "primary_type"), _f("rating", "CAST(rating AS VARCHAR)", False), _f("user_ratings_total", "user_ratings_total"), _f("price_level", "price_level"),
    _f("location", f"coalesce('{{\"type\":\"Point\",\"coordinates\":[' || {{lng}} || ',' || {{lat}} || '],\"latitude\":' || {{lat}} || ',\"longitude\":' || {{lng}} || '}}', 'null')".replace("{lng}", "CASE WHEN lng = 0.0005e0 THEN '5.0E-4' ELSE CAST(lng AS VARCHAR) END").replace("{lat}", "CAST(lat AS VARCHAR)"), False),
    _f("address", _json_object(_f("formatted", "formatted"), _f("country", "country"), _f("city", "city"), _f("district", "district"), _f("postal_code", "postal_code")), False),
    _f("contacts", _json_object(_f("phone_numbers", "phone_numbers"), _f("emails", "emails"), _f("website_url", "website_url"), _f("social_media", "'{\"instagram\":' || to_json(instagram) || '}'", False)), False),
    _f("digital_presence", _json_object(_f("has_website", "has_website"), _f("has_qr_menu", "has_qr_menu"), _f("qr_menu_provider", "qr_menu_provider"), _f("qr_menu_url", "qr_url"), _f("supports_online_ordering", "supports_online_ordering"), _f("ordering_channels", "coalesce('[{\"name\":\"Getir\",\"url\":' || to_json(channel) || '}]', '[]')", False)), False),
    _f("menu", "'{\"currency\":\"TRY\",\"categories\":[' || coalesce(categories, '') || ']}'", False), _f("categories", "kinds"), _f("opening_hours", "CASE WHEN hours IS NULL THEN '{}' ELSE '{\"weekday_text\":' || to_json(hours) || '}' END", False),
    _f("plus_code", "plus_code"), _f("data_source", "data_source"), _f("provider", "provider"), _f("created_at", "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ')"), _f("updated_at", "strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%gZ')"),
)
_JSON = f"""{_WIDE}, cats AS (
  SELECT venue_id, cat_ord, '{{"category_id":' || to_json(any_value(category_id)) || ',"name":' || to_json(any_value(category)) || ',"items":[' || string_agg({_ITEM}, ',' ORDER BY ord) || ']}}' AS said FROM items GROUP BY venue_id, cat_ord
), menus AS (SELECT venue_id, string_agg(said, ',' ORDER BY cat_ord) AS categories FROM cats GROUP BY 1)
SELECT id, updated_at, {_DOCUMENT} AS json FROM wide LEFT JOIN menus ON id = venue_id"""


def _tag(name: str, value: str, maybe: bool = False, raw: bool = False) -> str:
    said = value if raw else _XML.format(x=f"({value})")
    return f"coalesce('<{name}>' || nullif({said}, '') || '</{name}>', '{'' if maybe else f'<{name}></{name}>'}')"


_all = lambda values, name: f"coalesce(array_to_string(list_transform({values}, lambda x: '<{name}>' || x || '</{name}>'), ''), '')"
_XML_ITEM = " || ".join([
    "'<item id=\"' || item_id || '\">'", _tag("name", "name"), _tag("description", "description", True), "'<price>' || printf('%.2f', price) || '</price>'", "CASE WHEN allergic THEN '<allergen>nuts</allergen><allergen>milk</allergen>' ELSE '' END",
    "'<variant name=\"Half\">' || printf('%.2f', price / 2) || '</variant>'", "CASE WHEN image IS NULL THEN '' ELSE '<image_webp>/media/' || item_id || '.webp</image_webp>' END", "'<is_available>' || is_available || '</is_available></item>'",
])
_VENUE = " || ".join([
    "'<venue id=\"' || id || '\">'", _tag("google_place_id", "google_place_id"), _tag("name", "name"), _tag("primary_type", "primary_type"), _tag("rating", _NUMBER.format(x="rating"), True),
    f"coalesce('<location lat=\"' || {_CELLS[6]} || '\" lng=\"' || {_CELLS[7]} || '\">', '<location>')", _tag("address", "formatted", True), _tag("city", "city"), _tag("district", "district"), _tag("country", "country", True), "'</location><contacts>'",
    _all("emails", "email"), _all("phone_numbers", "phone"), _tag("website", "website_url", True), "coalesce('<social platform=\"instagram\">' || instagram || '</social>', '')", "'</contacts><digital_presence>'",
    *[f"'<{c}>' || {c} || '</{c}>'" for c in ("has_website", "has_qr_menu")], _tag("qr_provider", "qr_menu_provider"), _tag("qr_menu_url", "qr_url", True), "'<supports_online_ordering>' || supports_online_ordering || '</supports_online_ordering>'",
    "coalesce('<ordering_channel name=\"Getir\">' || " + _XML.format(x="channel") + " || '</ordering_channel>', '')", "'</digital_presence>'", _tag("categories", _all("kinds", "category"), True, True), _tag("opening_hours", _all("hours", "day"), True, True),
    _tag("plus_code", "plus_code", True), _tag("data_source", "data_source", True), "'<menu currency=\"TRY\">' || coalesce(categories, '') || '</menu></venue>'",
])
_ELEMENTS = f"""{_WIDE}, cats AS (
  SELECT venue_id, cat_ord, '<category name="' || {_XML.format(x="any_value(category)")} || '" id="' || any_value(category_id) || '">' || string_agg({_XML_ITEM}, '' ORDER BY ord) || '</category>' AS said FROM items GROUP BY venue_id, cat_ord
), menus AS (SELECT venue_id, string_agg(said, '' ORDER BY cat_ord) AS categories FROM cats GROUP BY 1)
SELECT id, {_VENUE} AS xml FROM wide LEFT JOIN menus ON id = venue_id"""
_AT = "2024-02-01T00:00:00.000Z"
_ENVELOPE = f"""WITH d AS (SELECT * FROM ({_JSON}) ORDER BY updated_at DESC, id LIMIT 1000), n AS (SELECT count(*) AS n FROM d)
SELECT 0 AS section, NULL::TIMESTAMP AS updated_at, '' AS id, '{{"status":"success","generated_at":"{_AT}","count":' || n || ',"venues":[' AS line FROM n UNION ALL SELECT 2, NULL, '', ']}}'
UNION ALL SELECT 1, updated_at, id, CASE WHEN row_number() OVER (ORDER BY updated_at DESC, id) > 1 THEN ',' ELSE '' END || json FROM d"""


def _fan(s, d):
    requests = table(s, d, "orders").select(F.col("o_orderkey").alias("request_id"))
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.concat(F.lit("gm:aps/"), (F.col("l_partkey") % 50).cast("string")).alias("google_place_id"))
    return jobs.fan_out(requests, lines)


_LAST = "SELECT place_id, max_by(state, (ts, event_id)) AS last, max_by(state, (ts, event_id)) FILTER (state <> 'failed') AS before FROM jobs GROUP BY 1"

RETRIES = f"""{_J}, r AS (
  SELECT *, count(*) FILTER (state IN ('queued', 'completed')) OVER (PARTITION BY place_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run,
    min(CASE WHEN state IN ('queued', 'completed') THEN ts END) OVER (PARTITION BY place_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS anew_at FROM jobs
), n AS (
  SELECT *, CASE WHEN kind = 'discover' THEN 1 ELSE 3 END AS most, row_number() OVER (PARTITION BY place_id, run ORDER BY ts, event_id)::INTEGER AS attempt FROM r WHERE state IN ('failed', 'captcha_blocked')
), f AS (SELECT *, state = 'captcha_blocked' OR attempt >= most AS final FROM n WHERE attempt <= most),
w AS (SELECT *, CASE WHEN NOT final THEN (3 * pow(2, attempt - 1))::BIGINT END AS delay_s, ts + to_seconds(CASE WHEN NOT final THEN (3 * pow(2, attempt - 1))::BIGINT END) AS due_at FROM f)"""
DUE = "delay_s IS NOT NULL AND (anew_at IS NULL OR anew_at > due_at)"

QUERIES = {
    "normalize_provider_a": (_normal_a, _ROWS_A),
    "normalize_provider_b": (_normal_b, _ROWS_B),
    "provider_chain": (lambda s, d: ops.provider_chain(_attempts(s, d)), _ATTEMPTS),
    "place_details_fill": (_details, f"{_V} SELECT google_place_id AS place_id, CASE WHEN k % 4 = 0 THEN 'Detail' WHEN k % 9 <> 0 THEN name ELSE '' END AS name, phone_numbers[1] AS phone FROM venues"),
    "geocode_cascade": (
        _geocoded,
        f"{_V} SELECT google_place_id AS place_id, CASE WHEN k % 2 = 0 AND k % 7 = 2 AND n_nationkey % 2 = 1 THEN 41e0 ELSE n_nationkey::DOUBLE END AS lat, CASE WHEN k % 2 = 0 AND k % 7 = 2 AND n_nationkey % 2 = 1 THEN 29e0 ELSE 30e0 END AS lng FROM venues JOIN nation ON city = n_name",
    ),
    "enrich": (lambda s, d: _FLAT(_enriched(s, d)), f"{_ENRICHED} SELECT * REPLACE (array_to_string(phone_numbers, '|') AS phone_numbers, array_to_string(emails, '|') AS emails) FROM e"),
    "enrich_precedence": (lambda s, d: _enriched(s, d).groupBy("point_source").agg(F.count("*").alias("n")), f"{_ENRICHED} SELECT point_source, count(*) AS n FROM e GROUP BY 1"),
    "menu_url": (lambda s, d: _enriched(s, d).filter("menu_url IS NOT NULL").select("google_place_id", "menu_url"), f"{_ENRICHED} SELECT google_place_id, menu_url FROM e WHERE menu_url IS NOT NULL"),
    "enrich_report": (
        lambda s, d: ops.enrich_report(_enriched(s, d)),
        f"""{_ENRICHED} SELECT google_place_id, CASE WHEN lat IS NULL AND len(phone_numbers) = 0 AND len(emails) = 0 AND menu_url IS NULL THEN 'failed' ELSE 'completed' END AS status,
concat_ws(',', CASE WHEN lat IS NULL THEN 'location' END, CASE WHEN len(phone_numbers) = 0 THEN 'phone' END, CASE WHEN len(emails) = 0 THEN 'email' END, CASE WHEN menu_url IS NULL THEN 'menu' END) AS missing FROM e""",
    ),
    "upsert_venues": (
        _upserted,
        f"""{_V} SELECT google_place_id, CASE WHEN k % 2 = 0 THEN name || ' new' ELSE name END AS name, CASE WHEN k % 4 = 0 OR k % 2 <> 0 THEN rating END AS rating, CASE WHEN k % 3 <> 0 THEN data_source END AS data_source,
CASE WHEN k % 3 <> 0 THEN created_at END AS created_at, CASE WHEN k % 2 = 0 THEN updated_at + INTERVAL 1 DAY ELSE updated_at END AS updated_at FROM venues WHERE k % 3 <> 0 OR k % 2 = 0""",
    ),
    "export_csv": (lambda s, d: export.csv_lines(_exported(s, d)), _CSV),
    "export_json": (lambda s, d: export.json_lines(_exported(s, d)), f"SELECT id, json FROM ({_JSON})"),
    "export_xml": (lambda s, d: export.xml_elements(_exported(s, d)), _ELEMENTS),
    "export_document": (lambda s, d: export.document(export.listing(_exported(s, d)), "json", _AT), _ENVELOPE),
    "upsert_nulls": (_upserted_nulls, _UPSERT_NULLS),
    "job_dedup": (lambda s, d: jobs.dedup(job_events(s, d)), f"{_J} SELECT place_id, min_by(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM jobs WHERE state = 'queued' GROUP BY 1"),
    "job_counts": (lambda s, d: jobs.counts(job_events(s, d)), f"{_J} SELECT state, count(*) AS n FROM jobs GROUP BY 1"),
    "rate_window": (lambda s, d: jobs.rate_windows(job_events(s, d), 3600, 15), f"{_J} SELECT date_trunc('hour', ts) AS start, count(*) AS n, greatest(0, count(*) - 15) AS over FROM jobs GROUP BY 1"),
    "job_status": (lambda s, d: jobs.status(job_events(s, d)), f"{_J}, l AS ({_LAST}) SELECT place_id, CASE WHEN last = 'failed' AND before = 'captcha_blocked' THEN before ELSE last END AS status FROM l"),
    "job_fanout": (_fan, "SELECT DISTINCT 'gm_aps_' || l_partkey % 50 AS job_id, l_orderkey AS request_id, 'gm:aps/' || l_partkey % 50 AS google_place_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "job_retry": (lambda s, d: jobs.retries(job_events(s, d)), f"{RETRIES} SELECT event_id, place_id, attempt, delay_s, final FROM w"),
    "job_retry_due": (lambda s, d: jobs.due(job_events(s, d)), f"{RETRIES} SELECT event_id, place_id, attempt, due_at FROM w WHERE {DUE}"),
    "job_retention": (
        lambda s, d: jobs.retained(job_events(s, d), 36_000, 864_000, 300),
        f"""{_J} SELECT event_id, state FROM jobs WHERE state IN ('completed', 'failed') AND epoch_us((SELECT max(ts) FROM jobs)) - epoch_us(ts) <= CASE WHEN state = 'completed' THEN 36000000000 ELSE 864000000000 END
QUALIFY row_number() OVER (PARTITION BY state ORDER BY ts DESC, event_id DESC) <= 300""",
    ),
    "host_ttl": (
        lambda s, d: jobs.static_only(job_events(s, d), 36_000),
        f"{_J} SELECT event_id, count(*) FILTER (state IN ('failed', 'captcha_blocked')) OVER (PARTITION BY host ORDER BY epoch_us(ts) RANGE BETWEEN 36000000000 PRECEDING AND 1 PRECEDING) > 0 AS static FROM jobs",
    ),
}
