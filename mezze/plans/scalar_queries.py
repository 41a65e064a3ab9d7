"""Queries that apply the column functions to lines of documents, venues, page addresses and literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from mezze.functions import scalars
from mezze.operators.pages import currency_of_site
from mezze.operators.venues import radius_zoom
from mezze.plans.views import LINES, VENUES, line_stream, table, venues

PRICES = ("₺110,00", "110.00 TL", "1.250,50", "1,250.50", "1250", "1.250", "12 000,5 €", "free", "0,00", "$ 7.5", "1.234.567,8", "EUR 20", "£3")
ARIA = ("Address: Moda Cad. 1", "Adres:  Kadıköy/İstanbul ", "phone:tel:+90 532 123 45 67", "PHONE:TEL: 0216 1", "phone:tel:", "a label that is much too long: kept", "Name:", ": x", "12:30 - 14:00", "")
RATINGS = ("4.7", "4,7", "5 stars", "6.1", "0", "none", "(1.840)", "150 reviews", "12,345 yorum", "4.2", "4.2 stars", "3 yıldız")
PHONES = ("+90 532 123 45 67", "0532 123 45 67", "905321234567", "5321234567", "1321234567", "+49 30 1234567", "+12", "tel", "0(312) 123 45 67", "90123")
EMAILS = ("info@venue.com.tr", "ornek@sitem.com", "a1b2c3d4e5f60718@x.io", "noreply@x.com", "img@2x.png", "x@sentry.io", " Mixed@Case.ORG ", "no at", "örnek@sitem.com", "name@yoursite.net")
ADDRESSES = ("Osmanağa, Halitağa Cd. No:10A, 34714 Kadıköy/İstanbul", "Merkez Mah., Çankaya/Ankara, Türkiye", "Girne, KKTC", "Turkey", "", "Atatürk Mahallesi, 06100 Ankara", "a,b , c/d/e", "Main St 5, 12345")
TITLES = ("Lezzet Durağı | QR Menü", "Ana Sayfa - Köfteci Ali", "Menü", "  Bar\tCafe  ·  x ", "A – B", "", "x" * 130)
HREFS = (
    "https://www.google.com/maps/place/VAU+COFFEE+KADIK%C3%96Y/data=!4m7!3m6!1s0x14cab9206d79cf0b:0x46da4e133c86ea24!8m2!3d40.991179!4d29.0281696!16s%2Fg%2F11abc",
    "https://www.google.com/maps/place/A+B/@41.01,28.97,17z/data=!19sChIJabc-_1", "https://www.google.com/maps/place/Only+Name/@41.5,28.5,17z", "https://x.com/", "/maps/place/caf%25C3%25A9/data=!16s%2Fm%2F02x",
)
URLS = ("venue.com", " HTTPS://www.Venue.com/Menu/?a=1 ", "ftp://x.y", "nohost", "http://a.b/c//", "", "https://user@www.x.org:80/p#f")
IMAGES = ("https://cdn.x/a.jpg?width=100&height=50&quality=10", "https://c.io/w_100,h_90,q_30/a.png?w=10&h=5&q=1", "https://s.app/_next/image?url=https%3A%2F%2Fc.io%2Fw_10%2Fb.jpg&w=64", "/local.png", " x?W=1 ")
DIRTY = ("https:\\/\\/x.com\\/a", "https://l.instagram.com/?u=https%3A%2F%2Fvenue.com%2Fmenu&e=1", "u00253A", "https%253A%252F%252Fy.com", "plain+text", "%zz")


def _literals(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x string")


def _values(values) -> str:
    rows = ", ".join(f"({i}, '" + v.replace("'", "''") + "')" for i, v in enumerate(values))
    return f"literals(i, x) AS (VALUES {rows})"


def _over(values, **functions):
    """Functions over the literals' column x, and over the lines of documents under ids of their own."""

    def query(s, d):
        lines = line_stream(s, d).select((F.col("page") * 100000 + F.col("ord") + 1000).alias("i"), F.col("line").alias("x"))
        return _literals(s, values).unionByName(lines).select("i", *[f(F.col("x")).alias(n) for n, f in functions.items()])

    return query


def _alone(values, **functions):
    return lambda s, d: _literals(s, values).select("i", *[f(F.col("x")).alias(n) for n, f in functions.items()])


def _with(values, rows, **functions):
    """Functions over the literals' column x, and over the rows (i, x) of a table, whose ids start at 1000."""
    return lambda s, d: _literals(s, values).unionByName(rows(s, d)).select("i", *[f(F.col("x")).alias(n) for n, f in functions.items()])


def _of_venues(said):
    return lambda s, d: venues(s, d).select((F.col("id").cast("long") + 1000).alias("i"), said().alias("x")).filter("x IS NOT NULL")


def _of_pages(said):
    return lambda s, d: table(s, d, "pages").select((F.col("page_id") + 1000).alias("i"), said().alias("x"))


_place_link = lambda: F.concat(F.lit("https://www.google.com/maps/place/"), F.replace("name", F.lit("#"), F.lit("%23")), F.lit("+Cafe/@1,2,17z/data=!3d"), F.col("location.coordinates")[1].cast("string"), F.lit("!4d"), F.col("location.coordinates")[0].cast("string"), F.lit("!16s%2Fg%2F"), F.col("id"))


def _input(values) -> str:
    return f"WITH {_values(values)}, {LINES}, input AS (SELECT i::BIGINT AS i, x FROM literals UNION ALL SELECT page * 100000 + ord + 1000, line FROM lines)"


def _price_sql(x: str) -> str:
    raw = rf"regexp_replace(regexp_extract({x}, '{scalars.PRICE}', 1), '\s', '', 'g')"
    last = lambda c: f"(CASE WHEN contains(r, '{c}') THEN length(r) - position('{c}' IN reverse(r)) ELSE -1 END)"
    plain = rf"CASE WHEN {last(',')} > {last('.')} THEN regexp_replace(replace(r, '.', ''), '^([0-9]*),', '\1.') ELSE replace(r, ',', '') END"
    value = rf"list_transform([{raw}], lambda r: try_cast(nullif(regexp_extract({plain}, '^([0-9]*(\.[0-9]*)?)', 1), '') AS DOUBLE))"
    return f"list_filter({value}, lambda v: v > 0)[1]"


def _currency_sql(x: str, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{c}'" for c, p in scalars.CURRENCIES) + f" ELSE {default} END"


def _phone_sql(x: str) -> str:
    t = f"regexp_replace({x}, '[^0-9+]', '', 'g')"
    own = f"CASE WHEN starts_with({t}, '+90') THEN substr({t}, 4) WHEN starts_with({t}, '90') AND length({t}) = 12 THEN substr({t}, 3) WHEN starts_with({t}, '0') THEN substr({t}, 2) WHEN starts_with({t}, '+') THEN NULL ELSE {t} END"
    return f"CASE WHEN starts_with({t}, '+') AND NOT starts_with({t}, '+90') AND length({t}) BETWEEN 9 AND 16 THEN {t} WHEN regexp_matches({own}, '^[2-9][0-9]{{9}}$') THEN '+90' || ({own}) END"


_RATING = "try_cast(replace(regexp_extract(x, '([0-9]+[.,][0-9]+|[0-9]+)', 1), ',', '.') AS DOUBLE)"
_DIGITS = r"regexp_extract(regexp_replace(x, '[()\s]', '', 'g'), '([0-9.,]+)', 1)"
_MAIL = "lower(trim(x, ' '))"
_FOLD = r"trim(regexp_replace(regexp_replace(translate(lower(translate(x, 'İI', 'iı')), 'ğüşöçı', 'gusoci'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ')"
_IMAGE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)([?&])(w|width)=[0-9]+', '\1\2=800', 'g'), '(?i)([?&])(h|height)=[0-9]+', '\1\2=800', 'g'), '(?i)([?&])(q|quality)=[0-9]+', '\1\2=90', 'g'), '(?i)/w_[0-9]+(?:,h_[0-9]+)?(?:,q_[0-9]+)?/', '/w_800,h_800,q_90/', 'g')"""


def _address(x):
    a = scalars.parse_address(x)
    return F.concat_ws("|", *[F.coalesce(a[k], F.lit("-")) for k in ("city", "district", "neighborhood", "postal_code")])


def _hours(s, d):
    rows = [(0, [("Mon", " 09:00 –  22:00 "), ("Tue", None), (None, "x"), (None, None)]), (1, []), (2, None)]
    return s.createDataFrame(rows, "i long, rows array<struct<day:string,hours:string>>").select("i", F.array_join(scalars.join_hours(F.col("rows")), ";").alias("hours"))


def _components(s, d):
    rows = [
        (0, [("İstanbul", ["administrative_area_level_1", "political"]), ("Kadıköy", ["administrative_area_level_2"]), ("Türkiye", ["country"])], "x"),
        (1, [("Town", ["locality"]), ("Part", ["sublocality"])], None), (2, [], "Street 1, 34714 Kadıköy/İstanbul"), (3, None, "a/b/c"),
    ]
    out = s.createDataFrame(rows, "i long, c array<struct<long_name:string,types:array<string>>>, f string")
    return out.select("i", scalars.address_components(F.col("c"), F.col("f")).alias("a")).select("i", "a.*")


def _item_ids(s, d):
    parts = table(s, d, "part")
    return parts.select("p_partkey", scalars.short_id(F.lower(F.concat(F.col("p_brand"), F.lit(":"), F.col("p_name"))), "item").alias("item_id"), scalars.short_id(F.col("p_brand"), "cat").alias("category_id"))


def _href(s, d):
    p = scalars.place_href(F.col("x"))
    return _literals(s, HREFS).unionByName(_of_venues(_place_link)(s, d)).select("i", p.alias("p")).select("i", "p.*")


def _search(s, d):
    v = venues(s, d).filter("location IS NOT NULL")
    return v.select("id", scalars.search_url(F.concat(F.col("address.city"), F.lit(" kafe & çay+")), F.lit(41.5), F.lit(29.25), radius_zoom(F.lit(2000.0))).alias("url"))


def _links(s, d):
    base = "https://Venue.com/tr/menu/index.html?a=1"
    hrefs = ("/118/", "drinks", "../food/./", "?p=2", "#x", "//venue.com/a", "https://venue.com/b.png", "mailto:a@b.c", "https://other.com/", "https://venue.com/index.php?x=1", "https://venue.com", "", "a/b/c/../../../../../../../d", "a//b/..", "./x/y/%2E%2e#z", "HTTPS://VENUE.com:443/p", "http://venue.com:81/")
    of_pages = table(s, d, "pages").select((F.col("page_id") + 1000).alias("i"), scalars.normalize_link(F.concat(F.lit("/menu/./x/../"), F.col("page_id").cast("string"), F.lit("/index.html#top")), F.col("url")).alias("url"))
    return _literals(s, hrefs).select("i", scalars.normalize_link(F.col("x"), F.lit(base)).alias("url")).unionByName(of_pages)


_BLOCKS = [(0, "https://x/sorry/index", 200, "", ""), (1, "https://x", 429, "", ""), (2, "https://x", 200, "Unusual traffic", ""), (3, "https://x", None, None, "<form id='captcha-form'>"), (4, "https://x", 200, "Menu", "<p>ok</p>"), (5, None, None, None, None)]


def _blocked(s, d):
    pages = table(s, d, "pages").select((F.col("page_id") + 100).alias("i"), "url", F.lit(200).alias("status"), F.lit("").alias("title"), "html")
    rows = s.createDataFrame(_BLOCKS, "i long, url string, status int, title string, html string").unionByName(pages)
    return rows.select("i", scalars.detect_block(F.col("url"), F.col("status"), F.col("title"), F.col("html")).alias("blocked"))


_BLOCKED_SQL = """SELECT i::BIGINT AS i, blocked FROM (VALUES (0, true), (1, true), (2, true), (3, true), (4, false), (5, false)) t(i, blocked)
UNION ALL SELECT page_id + 100, regexp_matches(url, '(?i)/sorry/') OR regexp_matches(substr(html, 1, 200000), '(?i)captcha-form|g-recaptcha|recaptcha/api\\.js|/sorry/index|our systems have detected unusual traffic') FROM pages"""

QUERIES = {
    "parse_price": (_over(PRICES, price=scalars.parse_price), f"{_input(PRICES)} SELECT i, {_price_sql('x')} AS price FROM input"),
    "parse_price_strict": (_alone(PRICES, price=lambda x: scalars.parse_price(x, strict=True)), "SELECT i::BIGINT AS i, price FROM (VALUES (0, 110e0), (1, 110e0), (2, 1250.5e0), (3, 1250.5e0), (4, 1250e0), (5, 1.25e0), (6, 12000.5e0), (7, NULL), (8, NULL), (9, 7.5e0), (10, 1234567.8e0), (11, 20e0), (12, 3e0)) t(i, price)"),
    "detect_currency": (_over(PRICES, currency=scalars.detect_currency, stated=lambda x: scalars.detect_currency(x, None)), f"{_input(PRICES)} SELECT i, {_currency_sql('x', chr(39) + 'TRY' + chr(39))} AS currency, {_currency_sql('x', 'NULL')} AS stated FROM input"),
    "currency_of_site": (
        lambda s, d: currency_of_site(table(s, d, "documents"), "source", "doc_id", "text"),
        f"WITH t AS (SELECT source, doc_id, {_currency_sql('text', 'NULL')} AS code FROM documents) SELECT source, coalesce(min_by(code, doc_id) FILTER (code IS NOT NULL), 'TRY') AS currency FROM t GROUP BY source",
    ),
    "aria_labels": (
        _over(ARIA, label=scalars.strip_aria_prefix, phone=scalars.phone_item_id),
        rf"{_input(ARIA)} SELECT i, nullif(regexp_replace(regexp_replace(x, '^[^:]{{1,24}}:[\s\x0B]*', ''), '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), '') AS label, nullif(trim(regexp_extract(x, '(?i)phone:tel:(.+)$', 1), ' '), '') AS phone FROM input",
    ),
    "parse_rating": (_over(RATINGS, rating=scalars.parse_rating), f"{_input(RATINGS)} SELECT i, CASE WHEN {_RATING} > 0 AND {_RATING} <= 5 THEN {_RATING} END AS rating FROM input"),
    "parse_reviews": (_over(RATINGS, reviews=scalars.parse_reviews), rf"{_input(RATINGS)} SELECT i, CASE WHEN NOT regexp_matches(x, '(?i)star|yıldız') AND NOT regexp_matches({_DIGITS}, '^[0-9]+[.,][0-9]$') THEN try_cast(regexp_replace({_DIGITS}, '[.,]', '', 'g') AS BIGINT) END AS reviews FROM input"),
    "normalize_phone": (_over(PHONES, phone=scalars.normalize_phone), f"{_input(PHONES)} SELECT i, {_phone_sql('x')} AS phone FROM input"),
    "contact_emails": (
        _over(EMAILS, contact=scalars.is_contact_email),
        rf"{_input(EMAILS)} SELECT i, regexp_matches({_MAIL}, '^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{{2,}}$') AND NOT regexp_matches({_MAIL}, '\.(png|jpe?g|gif|webp|svg|css|js)$') AND NOT regexp_matches({_MAIL}, '{scalars.MACHINE_DOMAINS}') AND NOT regexp_matches({_MAIL}, '{scalars.TEMPLATE_MAILBOXES}') AND NOT regexp_matches({_MAIL}, '^[0-9a-f]{{16,}}@') AND NOT regexp_matches({_MAIL}, '^(noreply|no-reply|donotreply|do-not-reply)@') AS contact FROM input",
    ),
    "parse_address": (_with(ADDRESSES, _of_venues(lambda: F.concat(F.lit("Moda Mah., "), F.col("address.formatted"), F.lit(" Sok., 34710 "), F.col("address.district"), F.lit("/"), F.col("address.city"))), parts=_address), f"WITH {VENUES} SELECT k + 1000 AS i, city || '|' || district || '|Moda|34710' AS parts FROM venues UNION ALL SELECT i::BIGINT AS i, parts FROM (VALUES (0, 'İstanbul|Kadıköy|Osmanağa|34714'), (1, 'Ankara|Çankaya|Merkez|-'), (2, 'Girne|-|-|-'), (3, 'Turkey|-|-|-'), (4, '-|-|-|-'), (5, 'Ankara|-|Atatürk|06100'), (6, 'e|c|a|-'), (7, '-|-|-|12345')) t(i, parts)"),
    "address_components": (_components, "SELECT i::BIGINT AS i, city, district, country FROM (VALUES (0, 'İstanbul', 'Kadıköy', 'Türkiye'), (1, 'Town', 'Part', NULL), (2, 'İstanbul', 'Kadıköy', NULL), (3, NULL, NULL, NULL)) t(i, city, district, country)"),
    "hours_join": (_hours, "SELECT i::BIGINT AS i, hours FROM (VALUES (0, 'Mon: 09:00 – 22:00;Tue;: x'), (1, ''), (2, NULL)) t(i, hours)"),
    "fold_text": (_over(("İSTANBUL Iğdır", "Şefin  Seçimi!", "", "Çay-Böreği 2'li"), folded=scalars.fold_text), f"{_input(('İSTANBUL Iğdır', 'Şefin  Seçimi!', '', 'Çay-Böreği 2' + chr(39) + 'li'))} SELECT i, {_FOLD} AS folded FROM input"),
    "url_key": (lambda s, d: table(s, d, "pages").select("page_id", scalars.url_key(F.col("url")).alias("key")), "SELECT page_id, 'web_' || substr(sha1(lower(regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', ''))), 1, 20) AS key FROM pages"),
    "ingest_urls": (
        lambda s, d: _literals(s, URLS).unionByName(_of_pages(lambda: F.concat(F.lit(" "), F.regexp_replace("url", "^https?://", "")))(s, d)).select("i", scalars.ingest_url(F.col("x")).alias("u")).select("i", "u.url", "u.host"),
        "SELECT i::BIGINT AS i, url, host FROM (VALUES (0, 'https://venue.com', 'venue.com'), (1, 'HTTPS://www.Venue.com/Menu/?a=1', 'venue.com'), (2, NULL, NULL), (3, NULL, NULL), (4, 'http://a.b/c//', 'a.b'), (5, NULL, NULL), (6, 'https://user@www.x.org:80/p#f', 'x.org')) t(i, url, host) UNION ALL SELECT page_id + 1000, 'https://' || regexp_replace(url, '^https?://', ''), regexp_replace(regexp_extract(url, '^https?://([^/:?#]+)', 1), '^www[.]', '') FROM pages",
    ),
    "item_ids": (_item_ids, "SELECT p_partkey, 'item_' || substr(md5(lower(p_brand || ':' || p_name)), 1, 8) AS item_id, 'cat_' || substr(md5(p_brand), 1, 8) AS category_id FROM part"),
    "optimize_image_url": (
        _over(IMAGES, url=scalars.optimize_image_url),
        f"{_input(IMAGES)}, t AS (SELECT i, CASE WHEN contains(x, '_next/image') THEN url_decode(regexp_extract(x, '[?&]url=([^&#]+)', 1)) ELSE trim(x, ' ') END AS x FROM input) SELECT i::BIGINT AS i, {_IMAGE} AS url FROM t",
    ),
    "place_href": (
        _href,
        f"""WITH {VENUES} SELECT i::BIGINT AS i, cid, place_id, entity_id, lat, lng, coords_precise, name FROM (VALUES
  (0, '0x14cab9206d79cf0b:0x46da4e133c86ea24', NULL, '/g/11abc', 40.991179e0, 29.0281696e0, true, 'VAU COFFEE KADIKÖY'), (1, NULL, 'ChIJabc-_1', NULL, 41.01e0, 28.97e0, false, 'A B'),
  (2, NULL, NULL, NULL, 41.5e0, 28.5e0, false, 'Only Name'), (3, NULL, NULL, NULL, NULL, NULL, NULL, NULL), (4, NULL, NULL, '/m/02x', NULL, NULL, NULL, 'caf%C3%A9')) t(i, cid, place_id, entity_id, lat, lng, coords_precise, name)
UNION ALL SELECT k + 1000, NULL, NULL, '/g/' || k, lat, lng, true, name || ' Cafe' FROM venues WHERE lat IS NOT NULL""",
    ),
    "place_key": (
        lambda s, d: _literals(s, HREFS).unionByName(_of_venues(_place_link)(s, d)).select("i", scalars.place_key(scalars.place_href(F.col("x"))).alias("key")),
        f"WITH {VENUES} SELECT i::BIGINT AS i, key FROM (VALUES (0, 'gmaps_0x14cab9206d79cf0b_0x46da4e133c86ea24'), (1, 'ChIJabc-_1'), (2, 'gmaps_only-name_41.50000_28.50000'), (3, NULL), (4, 'gmaps_m_02x')) t(i, key) UNION ALL SELECT k + 1000, 'gmaps_g_' || k FROM venues WHERE lat IS NOT NULL",
    ),
    "clean_title": (_with(TITLES, _of_venues(lambda: F.concat(F.lit(" "), F.col("name"), F.lit("  Bar | QR Menü"))), name=scalars.clean_title), f"WITH {VENUES} SELECT k + 1000 AS i, name || ' Bar' AS name FROM venues UNION ALL SELECT i::BIGINT AS i, name FROM (VALUES (0, 'Lezzet Durağı'), (1, 'Köfteci Ali'), (2, 'Menü'), (3, 'Bar Cafe'), (4, 'A'), (5, NULL), (6, NULL)) t(i, name)"),
    "clean_url": (_with(DIRTY, _of_venues(lambda: F.concat(F.lit("https:\\/\\/v.exampleu002f"), F.col("id"), F.lit("?q=a%2520b+c "))), url=scalars.clean_url), f"WITH {VENUES} SELECT k + 1000 AS i, 'https://v.example/' || k || '?q=a b+c' AS url FROM venues UNION ALL SELECT i::BIGINT AS i, url FROM (VALUES (0, 'https://x.com/a'), (1, 'https://venue.com/menu'), (2, ':'), (3, 'https://y.com'), (4, 'plain+text'), (5, '%zz')) t(i, url)"),
    "search_url": (_search, f"WITH {VENUES} SELECT id, 'https://www.google.com/maps/search/' || url_encode(city || ' kafe & çay+') || '/@41.5,29.25,15z?hl=en' AS url FROM venues WHERE lng IS NOT NULL"),
    "normalize_link": (_links, "SELECT i::BIGINT AS i, url FROM (VALUES (0, 'https://venue.com/118/'), (1, 'https://venue.com/tr/menu/drinks'), (2, 'https://venue.com/tr/food/'), (3, 'https://venue.com/tr/menu/?p=2'), (4, 'https://venue.com/tr/menu/?a=1'), (5, 'https://venue.com/a'), (6, NULL), (7, NULL), (8, NULL), (9, 'https://venue.com/?x=1'), (10, 'https://venue.com/'), (11, 'https://venue.com/tr/menu/?a=1'), (12, 'https://venue.com/d'), (13, 'https://venue.com/tr/menu/a//'), (14, 'https://venue.com/tr/menu/x/'), (15, 'https://venue.com/p'), (16, NULL)) t(i, url) UNION ALL SELECT page_id + 1000, regexp_extract(url, '^https?://[^/?#]+') || '/menu/' || page_id || '/' FROM pages"),
    "detect_block": (_blocked, _BLOCKED_SQL),
}
