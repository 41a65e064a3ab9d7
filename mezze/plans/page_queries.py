"""Queries over captured pages, and over pages written here where the tables have none of a kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from mezze.operators import pages as ops
from mezze.plans.views import table

SITE = """<html lang=tr><head><title>Menü | Barış Pide</title><link rel="alternate" hreflang="en-US" href="/en/">
<script type="application/ld+json">{"@graph": [{"@type": "Restaurant", "name": "Barış Pide", "telephone": "+90 312 111 22 33", "address": {"streetAddress": "Cadde 1", "addressLocality": "Çankaya"}, "geo": {"latitude": 39.9128, "longitude": 32.7599},
"hasMenu": {"@type": "Menu", "hasMenuSection": [{"name": "Pide", "hasMenuItem": [{"name": "Kıymalı", "offers": {"price": "110,50", "priceCurrency": "TRY"}}, {"name": "Peynirli", "offers": [{"price": 95}]}], "hasMenuSection": {"name": "Özel", "menuItem": {"name": "Karışık"}}}, {"hasMenuItem": [{"name": "Ayran", "offers": {"price": "20 TL"}}, {"description": "no name"}]}]}}]}</script>
<script type="application/ld+json">{broken</script></head><body>
<a class=tile href=/118/><img src=a.jpg>Pideler</a><a class=tile href="/119/">Çorbalar</a><a class='tile' href='/120/'>İçecekler</a><a href="/118/487/" class="tile">Kıymalı Pide</a><a href="/iletisim">İletişim</a><a href="/en/118/">EN</a>
<a href="tel:0312 111 22 33">Ara</a> info@barispide.com.tr <a href="https://instagram.com/barispide">ig</a><a href="https://www.instagram.com/share/x">s</a> <a href="https://menulux.com/barispide">QR</a> <a href="https://www.yemeksepeti.com/x">Sipariş</a>
<p>Sodexo, VISA ve Nakit geçerlidir.</p><p>Pazartesi - Cuma: 09:00 - 22:00</p><p>Pazar 10.00–20.00</p><a href="https://yandex.com.tr/maps/?ll=32.759908,39.9128562&z=17">Yol</a></body></html>"""
STATE = """<html><script id="__NEXT_DATA__" type="application/json">{"props": {"menu": {"title": "Ana Menü", "categories": [{"name": "Kahveler", "products": [{"name": "Latte", "price": 95.5, "image": "a.jpg"}, {"title": "Mocha", "unit_price": 105}, {"name": "latte", "price": 1}]},
{"title": "Tatlılar", "items": [{"label": "Sütlaç", "price": "75,50 TL"}, {"name": "Kek", "price": {"amount": 60}, "categoryName": "Fırın"}, {"name": "x"}]}]}, "nav": [{"name": "Home"}, {"name": "About"}]}}</script></html>"""
EMPTY = "<html><body><p>Nothing here</p></body></html>"
_ROBOTS = [("http://a.example", "User-agent: x\nDisallow: /\n\nUser-agent: *\nUser-agent: y\nDisallow: /private # secret\nAllow: /private/open\nDisallow:\nUser-agent: z\nDisallow: /z"), ("http://b.example", ""), ("http://c.example", None)]
_PATHS = ("http://a.example/private/x", "http://a.example/private/open/1", "http://a.example/z", "http://b.example/", "http://c.example/q", "http://d.example/any", "http://A.example/private?x=1")


def _written(s):
    return s.createDataFrame([(1, "https://barispide.com/", SITE), (2, "https://empty.example/", EMPTY), (3, "https://null.example/", None)], "page_id long, url string, html string")


def _menus(s):
    return _written(s).unionByName(s.createDataFrame([(4, "https://state.example/", STATE)], "page_id long, url string, html string"))


#: What is put onto each page of the table by its number, and what the rules make of it: html, provider, url, channels.
_SIGNS = (
    ("<a href='https://Menulux.com/v{k}?a=1#top'>QR</a>", "'Menulux'", "'https://menulux.com/v' || k || '?a=1#top'", "''"),
    ('<script>{{"u":"https:\\/\\/menu.finedine.co\\/v{k}"}}</script><a href="https://getir.com/yemek/{k}">G</a>', "'FineDine'", "'https://menu.finedine.co/v' || k", "'GetirYemek https://getir.com/yemek/' || k"),
    ('<a href="/a/./b/../../menu/{k}">Menu</a> <a class=x href="/siparis/{k}">Order</a>', "'Self-hosted'", "origin || '/menu/' || k", "'Direct Web Order ' || origin || '/siparis/' || k"),
    ('<a href="https://qrmatic.com/">powered by</a><a href=//qr.adisyo.com/?v={k}>m</a> deliveroo.com.tr', "'Adisyo'", "regexp_extract(url, '^[a-z]+:') || '//qr.adisyo.com/?v=' || k", "'Deliveroo ' || url"),
    ('<a href="http://www.garsonum.com">powered by</a> dijitalmenu <b>', "'Sunmi/QRMenu'", "NULL", "''"),
    ("https://l.instagram.com/?u=https%3A%2F%2Fqmenu.com%2Fv{k}&e=1 <a href='x.pdf'>p</a>", "'Qmenu'", "'https://qmenu.com/v' || k", "''"),
    ("", "NULL", "NULL", "''"),
)


def _signed(s, d):
    """The pages, each with one of the signs."""
    sign = F.element_at(F.array(*[F.lit(x[0].format(k="{k}").replace("{{", "{").replace("}}", "}")) for x in _SIGNS]), (F.col("page_id") % len(_SIGNS) + 1).cast("int"))
    return table(s, d, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.replace(sign, F.lit("{k}"), F.col("page_id").cast("string"))))


_SIGNS_SQL = "WITH p AS (SELECT page_id, page_id AS k, url, regexp_extract(url, '^[a-z]+://[^/]*') AS origin FROM pages) SELECT page_id, {columns} FROM p"
_by_sign = lambda nth: f"CASE page_id % {len(_SIGNS)} " + " ".join(f"WHEN {i} THEN {x[nth]}" for i, x in enumerate(_SIGNS)) + " END"
_LD = """<script type="application/ld+json">{"@type": "Restaurant", "name": "Site {k}", "telephone": "+90 212 {k}", "address": {"streetAddress": "Street {k}", "addressLocality": "Town"}, "geo": {"latitude": 40.5, "longitude": 29.25},
"hasMenu": {"@type": "Menu", "hasMenuSection": [{"name": "Food", "hasMenuItem": [{"name": "Dish {k}", "offers": {"price": "{k},50", "priceCurrency": "TRY"}}, {"name": "Free {k}"}]}]}}</script><p>Sodexo, Troy</p><a href="https://menulux.com/v">m</a>"""
_APP = """<script id="__NEXT_DATA__" type="application/json">{"menu": {"categories": [{"name": "Hot", "products": [{"name": "Tea {k}", "price": 5.5}, {"name": "Soup {k}", "price": "{k},25 TL"}]}]}}</script> <p>Nakit</p> <a href="https://www.ubereats.com/x">u</a>"""


def _stocked(s, d, written):
    """The pages written here, and those of the table under ids from 1000 on, a third with structured data, a third with state."""
    k = F.col("page_id")
    block = F.replace(F.when(k % 3 == 0, F.lit(_LD)).when(k % 3 == 1, F.lit(_APP)).otherwise(F.lit("")), F.lit("{k}"), k.cast("string"))
    pages = table(s, d, "pages").select((k + 1000).alias("page_id"), "url", F.concat(F.coalesce("html", F.lit("")), block).alias("html"))
    return written(s).unionByName(pages)


_ON = "FROM (SELECT page_id + 1000 AS page_id, page_id AS k FROM pages) WHERE k % 3 = "
_APP_SQL = f"SELECT page_id, 'Hot' AS category, 'Tea ' || k AS name, 5.5e0 AS price {_ON}1 UNION ALL SELECT page_id, 'Hot', 'Soup ' || k, CAST(k AS DOUBLE) + 0.25e0 {_ON}1"
_LD_SQL = f"SELECT page_id, 'Food' AS category, 'Dish ' || k AS name, CAST(k AS DOUBLE) + 0.5e0 AS price {_ON}0 UNION ALL SELECT page_id, 'Food', 'Free ' || k, 0e0 {_ON}0"
_STATE_SQL = "SELECT 4::BIGINT AS page_id, category, name, price FROM (VALUES ('Kahveler', 'Latte', 95.5e0), ('Kahveler', 'Mocha', 105e0), ('Tatlılar', 'Sütlaç', 75.5e0), ('Fırın', 'Kek', 60e0)) t(category, name, price)"


def _robots(s):
    return ops.robots_rules(s.createDataFrame(_ROBOTS, "origin string, body string"))


def _paths(s):
    return s.createDataFrame([(u,) for u in _PATHS], "url string")


def _joined(df, *columns):
    return df.select("page_id", *[F.array_join(c, "|").alias(c) if c in columns else F.col(c) for c in df.columns if c != "page_id"])


def _crawl(s, d):
    pages = _written(s)
    captured = s.createDataFrame([("https://barispide.com/118/",), ("https://barispide.com/119/",)], "url string")
    rules = ops.robots_rules(s.createDataFrame([("https://barispide.com", "User-agent: *\nDisallow: /119/")], "origin string, body string"))
    return ops.crawl_plan(pages, captured, rules)


def _coordinates(s, d):
    from mezze.functions.scalars import page_coordinates

    rows = [(1, SITE), (2, "<a href='https://maps.google.com/?q=39.9123,32.7654'>"), (3, "src='https://www.google.com/maps/embed?pb=!2d29.0281!3d40.9911'"), (4, "?q=0.0001,0.0002 mlat=41.0123&amp;mlon=28.9876"), (5, EMPTY), (6, '{"latitude": "38.1234", "x": 1, "longitude": 27.4321}')]
    p = page_coordinates(F.col("html"))
    return s.createDataFrame(rows, "page_id long, html string").select("page_id", p["lat"].alias("lat"), p["lng"].alias("lng"))


def _profile(s, d):
    return ops.structured_profile(_written(s))


_TITLE = r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1)"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_entity}', '{_char}')"

QUERIES = {
    "pages_scan": (lambda s, d: table(s, d, "pages").select("page_id", "url", F.octet_length("html").cast("long").alias("html_bytes")), "SELECT page_id, url, strlen(html) AS html_bytes FROM pages"),
    "page_titles": (lambda s, d: ops.titles(table(s, d, "pages")).select("page_id", "title"), rf"SELECT page_id, trim(regexp_replace({_TITLE}, '\s+', ' ', 'g'), ' ') AS title FROM pages"),
    "page_links": (
        lambda s, d: ops.links(table(s, d, "pages")).select("page_id", "nth", "href", "label"),
        r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=[^>]*>.*?</a>') AS l FROM pages), b AS (SELECT page_id, unnest(range(len(l)))::INTEGER AS nth, unnest(l) AS a FROM a)
SELECT page_id, nth, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(replace(replace(replace(replace(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), ' ') AS label FROM b""",
    ),
    "page_languages": (
        lambda s, d: _joined(ops.languages(table(s, d, "pages")), "languages"),
        r"""WITH c AS (SELECT page_id, list_append(regexp_extract_all(html, '<a\b[^>]*?\shref\s*=\s*["'']?(?:https?://[^/"''>\s]+)?/([A-Za-z]{2})/', 1), regexp_extract(html, '<html\b[^>]*?\slang\s*=\s*["'']?([A-Za-z]+)', 1)) AS l FROM pages)
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(l, lambda x: lower(x)), lambda x: regexp_matches(x, '^[a-z]{2}$')))), '|') AS languages FROM c""",
    ),
    "section_links": (lambda s, d: ops.section_links(table(s, d, "pages").unionByName(_written(s).withColumn("page_id", -F.col("page_id")))), None),
    "site_scan": (
        lambda s, d: _joined(ops.site_scan(_written(s)).select("page_id", "emails", "phone_numbers", "socials.instagram", "qr_platform", "ordering_channels", "payment_methods"), "emails", "phone_numbers", "ordering_channels", "payment_methods"),
        "SELECT i::BIGINT AS page_id, * EXCLUDE (i) FROM (VALUES (1, 'info@barispide.com.tr', '+903121112233', 'https://instagram.com/barispide', 'Menulux', 'Yemeksepeti', 'Sodexo|Visa|Nakit'), (2, '', '', NULL, NULL, '', ''), (3, '', '', NULL, NULL, '', '')) t(i, emails, phone_numbers, instagram, qr_platform, ordering_channels, payment_methods)",
    ),
    "site_scan_pages": (
        lambda s, d: _joined(ops.site_scan(_stocked(s, d, lambda s: _written(s).limit(0)).withColumn("html", F.concat("html", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" Info"), F.col("page_id").cast("string"), F.lit("@Venue.com.tr x@2x.png <a href='tel:0312 111 22 33'>"))).otherwise("")))).drop("socials"), "emails", "phone_numbers", "ordering_channels", "payment_methods"),
        f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'info' || page_id || '@venue.com.tr' ELSE '' END AS emails, CASE WHEN page_id % 2 = 0 THEN '+903121112233' ELSE '' END AS phone_numbers, CASE WHEN k % 3 = 0 THEN 'Menulux' END AS qr_platform,
CASE WHEN k % 3 = 1 THEN 'UberEats' ELSE '' END AS ordering_channels, CASE k % 3 WHEN 0 THEN 'Sodexo|Troy' WHEN 1 THEN 'Nakit' ELSE '' END AS payment_methods {_ON.replace(" WHERE k % 3 = ", "")}""",
    ),
    "profile_hours": (lambda s, d: _joined(ops.opening_lines(_written(s).filter("html IS NOT NULL")), "hours"), "SELECT i::BIGINT AS page_id, hours FROM (VALUES (1, 'Pazartesi - Cuma: 09:00 - 22:00|Pazar 10.00–20.00'), (2, '')) t(i, hours)"),
    "profile_coords": (_coordinates, "SELECT i::BIGINT AS page_id, lat, lng FROM (VALUES (1, 39.9128562e0, 32.759908e0), (2, 39.9123e0, 32.7654e0), (3, 40.9911e0, 29.0281e0), (4, 41.0123e0, 28.9876e0), (5, NULL, NULL), (6, 38.1234e0, 27.4321e0)) t(i, lat, lng)"),
    "site_profile": (_profile, "SELECT 1::BIGINT AS page_id, 'Barış Pide' AS name, 'Cadde 1, Çankaya' AS address, '+90 312 111 22 33' AS phone, 39.9128e0 AS lat, 32.7599e0 AS lng"),
    "jsonld_nodes": (lambda s, d: ops.structured(_stocked(s, d, _written)).select("page_id", F.col("nth").cast("long").alias("nth"), F.try_variant_get("node", "$.@type", "string").alias("type")), "SELECT 1::BIGINT AS page_id, 0::BIGINT AS nth, 'Restaurant' AS type" + f" UNION ALL SELECT page_id, 0, 'Restaurant' {_ON}0"),
    "jsonld_menu": (
        lambda s, d: ops.structured_menu(_stocked(s, d, _written)).withColumn("ord", F.col("ord").cast("long")),
        "SELECT 1::BIGINT AS page_id, category, ord::BIGINT AS ord, name, price, 'TRY' AS currency FROM (VALUES ('Pide', 0, 'Kıymalı', 110.5e0), ('Pide', 1, 'Peynirli', 95e0), ('Özel', 2, 'Karışık', 0e0), ('Menü', 3, 'Ayran', 20e0)) t(category, ord, name, price)" + f" UNION ALL SELECT page_id, category, CASE WHEN starts_with(name, 'Dish') THEN 0 ELSE 1 END, name, price, 'TRY' FROM ({_LD_SQL})"),
    "app_json_menu": (lambda s, d: ops.embedded_menu(_stocked(s, d, _menus)).select("page_id", "category", "name", "price"), _STATE_SQL + f" UNION ALL {_APP_SQL}"),
    "page_menu": (
        lambda s, d: ops.page_menu(_stocked(s, d, _menus)).select("page_id", "category", "name", "price", "method"),
        f"SELECT *, 'next_data_json' AS method FROM ({_STATE_SQL}) UNION ALL SELECT 1, category, name, price, 'schema_org' FROM (VALUES ('Pide', 'Kıymalı', 110.5e0), ('Pide', 'Peynirli', 95e0), ('Özel', 'Karışık', 0e0), ('Menü', 'Ayran', 20e0)) t(category, name, price)" + f" UNION ALL SELECT *, 'schema_org' FROM ({_LD_SQL}) UNION ALL SELECT *, 'next_data_json' FROM ({_APP_SQL})"),
    "menu_method": (lambda s, d: ops.menu_methods(ops.page_menu(_stocked(s, d, _menus))), "SELECT i::BIGINT AS page_id, method, warnings FROM (VALUES (1, 'schema_org', '1 products without a price'), (4, 'next_data_json', NULL)) t(i, method, warnings)" + f" UNION ALL SELECT page_id, 'schema_org', '1 products without a price' {_ON}0 UNION ALL SELECT page_id, 'next_data_json', NULL {_ON}1"),
    "menu_result": (
        lambda s, d: ops.menu_result(_menus(s)),
        f"SELECT 'state.example' AS venue_id, category, name, price, 'next_data_json' AS method FROM ({_STATE_SQL}) UNION ALL SELECT 'barispide.com', category, name, price, 'schema_org' FROM (VALUES ('Pide', 'Kıymalı', 110.5e0), ('Pide', 'Peynirli', 95e0), ('Özel', 'Karışık', 0e0), ('Menü', 'Ayran', 20e0)) t(category, name, price)",
    ),
    "menu_platforms": (
        lambda s, d: ops.menu_platforms(_signed(s, d)).withColumn("ordering_channels", F.array_join(F.transform("ordering_channels", lambda c: F.concat_ws(" ", c["name"], c["url"])), "|")),
        _SIGNS_SQL.format(columns=f"{_by_sign(1)} IS NOT NULL AS has_qr_menu, {_by_sign(1)} AS qr_menu_provider, {_by_sign(2)} AS qr_menu_url, {_by_sign(3)} AS ordering_channels"),
    ),
    "qr_platform": (lambda s, d: ops.site_scan(_stocked(s, d, _written)).select("page_id", "qr_platform"), "SELECT i::BIGINT AS page_id, q AS qr_platform FROM (VALUES (1, 'Menulux'), (2, NULL), (3, NULL)) t(i, q)" + " UNION ALL SELECT page_id + 1000, CASE WHEN page_id % 3 = 0 THEN 'Menulux' END FROM pages"),
    "ordering_channels": (lambda s, d: ops.site_scan(_stocked(s, d, _written)).select("page_id", F.explode("ordering_channels").alias("channel")), "SELECT 1::BIGINT AS page_id, 'Yemeksepeti' AS channel" + f" UNION ALL SELECT page_id, 'UberEats' {_ON}1"),
    "payment_methods": (lambda s, d: ops.site_scan(_stocked(s, d, _written)).select("page_id", F.explode("payment_methods").alias("method")), "SELECT 1::BIGINT AS page_id, unnest(['Sodexo', 'Visa', 'Nakit']) AS method" + f" UNION ALL SELECT page_id, unnest(['Sodexo', 'Troy']) {_ON}0 UNION ALL SELECT page_id, 'Nakit' {_ON}1"),
    "profile_name": (lambda s, d: ops.profile_names(_menus(s)), "SELECT i::BIGINT AS page_id, name FROM (VALUES (1, 'Barış Pide'), (2, NULL), (3, NULL), (4, NULL)) t(i, name)"),
    "profile_address": (lambda s, d: ops.structured_profile(_stocked(s, d, _written)).select("page_id", "address"), "SELECT 1::BIGINT AS page_id, 'Cadde 1, Çankaya' AS address" + f" UNION ALL SELECT page_id, 'Street ' || k || ', Town' {_ON}0"),
    "image_storage_stats": (lambda s, d: ops.image_storage(s, f"{d}/nation.parquet").select("files", (F.col("bytes") > 0).alias("filled")), "SELECT 1::BIGINT AS files, true AS filled"),
    "robots_parse": (lambda s, d: _robots(s), "SELECT 'http://a.example' AS origin, prefix, allow FROM (VALUES ('/private', false), ('/private/open', true)) t(prefix, allow)"),
    "robots_allowed": (lambda s, d: ops.robots_allowed(_paths(s), _robots(s)), "SELECT url, allowed FROM (VALUES " + ", ".join(f"('{u}', {str(i not in (0, 6)).lower()})" for i, u in enumerate(_PATHS)) + ") t(url, allowed)"),
    "robots_pages": (
        lambda s, d: ops.robots_allowed(table(s, d, "pages").select("url").distinct(), table(s, d, "pages").select(F.regexp_extract("url", "^(https?://[^/?#]+)", 1).alias("origin")).distinct().withColumn("prefix", F.lit("/fr")).withColumn("allow", F.lit(False))),
        "SELECT DISTINCT url, NOT starts_with(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/fr') AS allowed FROM pages",
    ),
    "crawl_plan": (_crawl, "SELECT 1::BIGINT AS page_id, 'https://barispide.com/' || p || '/' AS url, state FROM (VALUES ('118', 'captured'), ('119', 'barred'), ('120', 'missing')) t(p, state)"),
}
