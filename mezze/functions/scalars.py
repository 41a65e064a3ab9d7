"""Column functions for prices, ratings, phones, addresses, links, titles and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns the results depend on.
CURRENCIES = [("TRY", r"(?i)₺|\bTL\b|\bTRY\b"), ("EUR", r"(?i)€|\bEUR\b"), ("USD", r"\$|\bUSD\b"), ("GBP", r"(?i)£|\bGBP\b")]
COUNTRIES = r"(?i)^(t[üÜu]rkiye|turkey|tr|kktc|k\.k\.t\.c\.?|cyprus|kibris|kıbrıs)$"
STREETS = r"(?i)[0-9]|cd\.|cad\.|sok|sk\.|blv|bulvar|no:"
MACHINE_DOMAINS = r"sentry\.io|sentry[0-9A-Za-z_-]*\.wixpress\.com|wixpress\.com|\.sentry\.|bugsnag|datadoghq|newrelic|litespeed|example\.(com|org|net)|domain\.com|yourdomain|email\.com|sentry-next"
TEMPLATE_MAILBOXES = r"^(ornek|örnek|example|sample|test|demo|isim|ad|adiniz|name|your[0-9a-z_-]*|mail|e-?mail|info)@(sitem|siteniz|siteadi|yoursite|mysite|website|sitename|domain|example|test|demo|mail|email|abc)\."
BLOCKED_URL = r"(?i)/sorry/|consent\.google\.com/m\?|ipv4\.google\.com/sorry"
BLOCKED_TITLE = r"(?i)unusual traffic|before you continue to google|our systems have detected"
BLOCKED_HTML = r"(?i)id=[\"']captcha-form[\"']|g-recaptcha|recaptcha/api\.js|/sorry/index|our systems have detected unusual traffic"
PLATFORM_NOISE = r"(?i)(qr\s*men[uüÜ]|dijital\s*men[uüÜ]|digital\s*menu|online\s*men[uüÜ]|men[uüÜ]\s*kart|^men[uüÜ]$|qrmatic|finedine|menulux|adisyo|menutown|qmenu|powered\s*by|ana\s*sayfa|home)"
PRICE = r"([0-9]{1,3}(?:[.,\s][0-9]{3})*(?:[.,][0-9]{1,2})?|[0-9]+(?:[.,][0-9]{1,2})?)"
STRICT_PRICE = r"([0-9]{1,3}(?:[.,\s][0-9]{3})+(?:[.,][0-9]{1,2})?(?![0-9])|[0-9]+(?:[.,][0-9]{1,2})?(?![0-9]))"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def once(value: Column, body) -> Column:
    """`body(value)`, with `value` evaluated once however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def parse_price(text: Column, strict: bool = False) -> Column:
    """The first price in a text: thousands apart by dot, comma or space, one or two decimals; null unless above 0.

    Without `strict`, a number of more than three digits in a row is read by its first three: the established behaviour.
    """

    def number(raw: Column) -> Column:
        place = lambda c: F.when(F.locate(c, raw) > 0, F.length(raw) - F.locate(c, F.reverse(raw))).otherwise(-1)
        # The last separator is the decimal one; a further dot ends the number.
        plain = F.when(place(",") > place("."), F.regexp_replace(F.regexp_replace(raw, r"\.", ""), "^([0-9]*),", "$1.")).otherwise(F.regexp_replace(raw, ",", ""))
        return F.regexp_extract(plain, r"^([0-9]*(?:\.[0-9]*)?)", 1).try_cast("double")

    value = once(F.regexp_replace(found(text, STRICT_PRICE if strict else PRICE), r"\s", ""), number)
    return once(value, lambda v: F.when(v > 0, v))


def detect_currency(text: Column, default: str | None = "TRY") -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, pattern in CURRENCIES:
        chain = chain.when(F.regexp_like(text, F.lit(pattern)), code)
    return chain.otherwise(F.lit(default))


def parse_rating(text: Column) -> Column:
    value = F.regexp_replace(found(text, r"([0-9]+[.,][0-9]+|[0-9]+)"), ",", ".").try_cast("double")
    return F.when((value > 0) & (value <= 5), value)


def parse_reviews(text: Column) -> Column:
    """A count of reviews; labels with stars and bare decimals are ratings and give null."""
    digits = found(F.regexp_replace(text, r"[()\s]", ""), r"([0-9.,]+)")
    count = F.regexp_replace(digits, "[.,]", "").try_cast("long")
    return F.when(~F.regexp_like(text, F.lit("(?i)star|yıldız")) & ~F.regexp_like(digits, F.lit(r"^[0-9]+[.,][0-9]$")), count)


def normalize_phone(raw: Column) -> Column:
    """E.164: national numbers of ten digits from 2 to 9 with +90, other international ones of 8 to 15 digits; else null."""
    t = F.regexp_replace(raw, "[^0-9+]", "")
    own = (
        F.when(t.startswith("+90"), F.substring(t, 4, 99)).when(t.startswith("90") & (F.length(t) == 12), F.substring(t, 3, 99))
        .when(t.startswith("0"), F.substring(t, 2, 99)).when(t.startswith("+"), F.lit(None).cast("string")).otherwise(t)
    )
    abroad = t.startswith("+") & ~t.startswith("+90") & F.length(t).between(9, 16)
    return F.when(abroad, t).when(F.regexp_like(own, F.lit("^[2-9][0-9]{9}$")), F.concat(F.lit("+90"), own))


def is_contact_email(value: Column) -> Column:
    """A mailbox someone reads: no asset names, machines, templates, hashes or no-reply addresses."""
    e = F.lower(F.trim(value))
    has = lambda p: F.regexp_like(e, F.lit(p))
    ok = has(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$") & ~has(r"\.(png|jpe?g|gif|webp|svg|css|js)$") & ~has(MACHINE_DOMAINS) & ~has(TEMPLATE_MAILBOXES)
    return F.coalesce(ok & ~has(r"^[0-9a-f]{16,}@") & ~has(r"^(noreply|no-reply|donotreply|do-not-reply)@"), F.lit(False))


def parse_address(formatted: Column) -> Column:
    """struct of city, district, neighborhood, postal_code of an address with its largest part last."""
    parts = F.filter(F.transform(F.split(F.coalesce(formatted, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    is_country = lambda s: F.regexp_like(s, F.lit(COUNTRIES))
    # Countries at the end go, but never the only part.
    kept = F.aggregate(F.reverse(parts), F.struct(F.array().cast("array<string>").alias("a"), F.size(parts).alias("left")), lambda s, x: F.when(
        (F.size(s["a"]) == 0) & (s["left"] > 1) & is_country(x), F.struct(s["a"].alias("a"), (s["left"] - 1).alias("left"))
    ).otherwise(F.struct(F.concat(s["a"], F.array(x)).alias("a"), s["left"].alias("left"))))["a"]
    tail, head = F.get(kept, F.lit(0)), F.get(kept, F.size(kept) - 1)
    bare = F.trim(F.regexp_replace(tail, r"^(.*?)(?<![0-9A-Za-z_])[0-9]{5}(?![0-9A-Za-z_])", "$1"))
    slash = F.split(bare, "/")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    several = F.size(slash) >= 2
    return F.struct(
        F.when(several, some(F.element_at(slash, -1))).otherwise(some(bare)).alias("city"),
        F.when(several, some(slash[0])).alias("district"),
        F.when((F.size(kept) >= 2) & ~F.regexp_like(head, F.lit(STREETS)), some(F.regexp_replace(head, r"(?i)\s+(mah\.?|mahallesi)$", ""))).alias("neighborhood"),
        found(tail, r"(?<![0-9A-Za-z_])([0-9]{5})(?![0-9A-Za-z_])").alias("postal_code"),
    )


def address_components(components: Column, formatted: Column) -> Column:
    """struct of city and district from typed components, else from the last part of an address with exactly one slash."""
    of = lambda kind: F.get(F.filter(components, lambda c: F.array_contains(c["types"], kind)), F.lit(0))["long_name"]
    tail = F.split(F.trim(F.element_at(F.split(formatted, ","), -1)), "/")
    pair = F.size(tail) == 2
    city = F.coalesce(of("administrative_area_level_1"), of("locality"), F.when(pair, F.trim(F.get(tail, F.lit(1)))))
    district = F.coalesce(of("administrative_area_level_2"), of("administrative_area_level_4"), of("sublocality"), F.when(pair, F.trim(F.regexp_replace(tail[0], r"[0-9]{5}", ""))))
    return F.struct(city.alias("city"), district.alias("district"), of("country").alias("country"))


def join_hours(rows: Column) -> Column:
    """`day: hours` of an array of (day, hours); a missing half is left out, and so are empty rows."""
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.filter(F.transform(rows, lambda r: F.when(tidy(r["hours"]) == "", tidy(r["day"])).otherwise(F.concat(tidy(r["day"]), F.lit(": "), tidy(r["hours"])))), lambda s: s != "")


def fold_text(text: Column) -> Column:
    """Lower-case ASCII letters, digits and single spaces; Turkish letters by their plain forms, both kinds of i before case."""
    low = F.lower(F.translate(F.coalesce(text, F.lit("")), "İI", "iı"))
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(low, "ğüşöçı", "gusoci"), r"[^a-z0-9\s]", " "), r"\s+", " "))


def url_key(url: Column) -> Column:
    """Key of a venue known by its site only: hash of origin and path in lower case, without query and closing slashes."""
    origin_path = F.regexp_replace(F.regexp_extract(url, r"^([^?#]*)", 1), "/+$", "")
    return F.concat(F.lit("web_"), F.substring(F.sha1(F.lower(origin_path)), 1, 20))


def ingest_url(raw: Column) -> Column:
    """struct of url, host (without www.) of an operator's link; null if it is none. A missing scheme is https."""
    t = F.trim(raw)
    url = F.when(F.regexp_like(t, F.lit("(?i)^https?://")), t).when(t != "", F.concat(F.lit("https://"), t))
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.locate(".", host) > 0, F.struct(url.alias("url"), F.regexp_replace(host, r"^www\.", "").alias("host")))


def short_id(value: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(value), 1, 8))


def optimize_image_url(url: Column) -> Column:
    """Width and height 800 and quality 90 in queries and path transforms; the target of an image proxy in its place."""
    t = F.trim(url)
    inner = F.when(F.contains(t, F.lit("_next/image")), F.try_url_decode(found(t, r"[?&]url=([^&#]+)")))
    t = F.coalesce(inner, t)
    for names, value in (("w|width", "800"), ("h|height", "800"), ("q|quality", "90")):
        t = F.regexp_replace(t, rf"(?i)([?&])({names})=[0-9]+", f"$1$2={value}")
    return F.regexp_replace(t, r"(?i)/w_[0-9]+(?:,h_[0-9]+)?(?:,q_[0-9]+)?/", "/w_800,h_800,q_90/")


def place_href(href: Column) -> Column:
    """struct of cid, place_id, entity_id, lat, lng, coords_precise, name of a map link; the viewport is a last resort."""
    d = F.coalesce(F.try_url_decode(F.replace(href, F.lit("+"), F.lit("%2B"))), href)
    exact = r"!3d(-?[0-9]+\.[0-9]+)!4d(-?[0-9]+\.[0-9]+)"
    view = r"@(-?[0-9]+\.[0-9]+),(-?[0-9]+\.[0-9]+)"
    coordinate = lambda g: F.coalesce(found(d, exact, g), found(d, view, g)).cast("double")
    return F.struct(
        found(d, r"(?i)!1s(0x[0-9a-f]+:0x[0-9a-f]+)").alias("cid"), F.coalesce(found(d, r"!19s(ChIJ[0-9A-Za-z_-]+)"), found(d, r"!1s(ChIJ[0-9A-Za-z_-]+)")).alias("place_id"),
        found(d, r"(?i)!16s(/[a-z]/[0-9A-Za-z_-]+)").alias("entity_id"), coordinate(1).alias("lat"), coordinate(2).alias("lng"),
        F.when(found(d, exact).isNotNull(), True).when(found(d, view).isNotNull(), False).alias("coords_precise"),
        F.nullif(F.trim(F.replace(found(d, r"/maps/place/([^/@]+)"), F.lit("+"), F.lit(" "))), F.lit("")).alias("name"),
    )


def place_key(p: Column) -> Column:
    """Identity of a parsed map link: its own id, else cell id, entity, or name and place; null without any."""
    slug = F.substring(F.regexp_replace(F.lower(p["name"]), "[^a-z0-9]+", "-"), 1, 40)
    named = F.concat(F.lit("gmaps_"), slug, F.lit("_"), F.format_string("%.5f", p["lat"]), F.lit("_"), F.format_string("%.5f", p["lng"]))
    return F.coalesce(
        p["place_id"], F.concat(F.lit("gmaps_"), F.regexp_replace(p["cid"], "(?i)[^0-9a-fx]", "_")), F.concat(F.lit("gmaps"), F.replace(p["entity_id"], F.lit("/"), F.lit("_"))),
        F.when(p["name"].isNotNull() & p["lat"].isNotNull() & p["lng"].isNotNull(), named),
    )


def clean_title(title: Column) -> Column:
    """The first part of a page title that is not a platform's, at most 120 characters; null if there is none."""
    t = F.trim(F.regexp_replace(title, r"\s+", " "))
    parts = F.filter(F.split(t, r" ?[|·•] ?| [-–—] "), lambda s: F.trim(s) != "")
    meaning = F.filter(parts, lambda s: ~F.regexp_like(F.trim(s), F.lit(PLATFORM_NOISE)) & (F.length(F.trim(s)) >= 2))
    chosen = F.trim(F.coalesce(F.get(meaning, F.lit(0)), F.get(parts, F.lit(0))))
    return F.when(F.length(chosen) <= 120, chosen)


def clean_url(raw: Column) -> Column:
    """A link out of markup or scripts: no backslashes, redirects unwrapped, escapes decoded twice."""
    t = F.replace(raw, F.lit("\\"), F.lit(""))
    t = F.when(F.contains(t, F.lit("instagram.com")), F.coalesce(F.try_url_decode(found(t, r"[?&]u=([^&#]+)")), t)).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, "(?i)u0025", "%"), "(?i)u002f", "/")
    for _ in range(2):
        t = F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)
    return F.trim(t)


def search_url(query: Column, lat: Column, lng: Column, zoom: Column, locale: str = "en") -> Column:
    said = F.replace(F.url_encode(F.trim(query)), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("https://www.google.com/maps/search/"), said, F.lit("/@"), lat.cast("string"), F.lit(","), lng.cast("string"), F.lit(","), zoom.cast("string"), F.lit(f"z?hl={locale}"))


def detect_block(url: Column, status: Column, title: Column, html: Column) -> Column:
    """Whether a captured page is a wall against robots; the first 200,000 characters of html count."""
    like = lambda c, p: F.coalesce(F.regexp_like(c, F.lit(p)), F.lit(False))
    return F.coalesce(status.isin(429, 503), F.lit(False)) | like(url, BLOCKED_URL) | like(title, BLOCKED_TITLE) | like(F.substring(html, 1, 200000), BLOCKED_HTML)


def page_coordinates(html: Column) -> Column:
    """struct of lat, lng a page states: longitude-first maps, then latitude-first links, embeds and structured data."""
    from mezze.operators.venues import valid_point

    number = r"(-?[0-9]{1,3}\.[0-9]{3,})"
    sources = [
        (rf"(?i)yandex\.[a-z.]+/(?:maps|harita)/[^\"'\s]*[?&](?:ll|pt)={number},{number}", 2, 1),
        (rf"(?i)(?<!yandex\.[^\"'\s]{{1,110}})(?:maps\.google\.[a-z.]+/\?q=|google\.[a-z.]+/maps/(?:place/[^/]*/)?@|[?&](?:q|ll|daddr|destination)=){number},\s*{number}", 1, 2),
        (rf"(?i)mlat={number}&(?:amp;)?mlon={number}", 1, 2), (rf"!2d{number}!3d{number}", 2, 1),
        (rf"(?i)\"latitude\"\s*:\s*\"?{number}\"?[^}}]*?\"longitude\"\s*:\s*\"?{number}", 1, 2),
    ]
    points = [F.struct(found(html, p, a).cast("double").alias("lat"), found(html, p, b).cast("double").alias("lng")) for p, a, b in sources]
    return F.coalesce(*[F.when(valid_point(p["lat"], p["lng"]), p) for p in points])


def _resolved(path: Column) -> Column:
    """A path without the segments `.` and `..`, however many there are; steps above the root stay at the root."""
    here, up = (".", "%2e"), ("..", ".%2e", "%2e.", "%2e%2e")
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    step = lambda s: F.lower(s).isin(*here, *up)
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, s: F.when(F.lower(s).isin(*up), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(step(s), done).otherwise(F.concat(done, F.array(s))),
    )
    ends = F.when(step(F.element_at(segments, -1)) & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), ends)


def normalize_link(href: Column, base: Column) -> Column:
    """A same-host page link, resolved as a URL is, without fragment and index file; null for other hosts, schemes and assets.

    Hosts are lower-cased and lose the scheme's usual port. Letters are not percent-encoded.
    """
    part = lambda c, nth: F.regexp_extract(c, r"(?i)^(https?:)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?", nth)
    h = F.trim(href)
    scheme = F.lower(F.coalesce(F.nullif(part(h, 1), F.lit("")), part(base, 1)))
    authority = lambda c: F.concat(F.regexp_extract(c, "^(.*@)?", 1), F.regexp_replace(F.lower(F.regexp_replace(c, "^.*@", "")), F.when(scheme == "https:", ":443$").otherwise(":80$"), F.lit("")))
    host = lambda c: F.regexp_replace(c, "^.*@", "")
    absolute = F.regexp_like(h, F.lit("(?i)^(https?:)?//"))
    own, path, query = F.when(absolute, part(h, 2)).otherwise(part(base, 2)), part(h, 3), part(h, 4)
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    merged = F.when(absolute | path.startswith("/"), path).when(path == "", part(base, 3)).otherwise(F.concat(folder, path))
    asked = F.when(absolute | (path != "") | (query != ""), query).otherwise(part(base, 4))
    page = _resolved(merged)
    other = F.regexp_like(h, F.lit("(?i)^(?!https?:)[a-z][a-z0-9+.-]*:"))
    asset = F.regexp_like(page, F.lit(r"(?i)\.(jpe?g|png|gif|webp|avif|svg|ico|css|js|mjs|json|xml|mp4|webm|mp3|zip|rar|woff2?|ttf)$"))
    same = (host(authority(own)) == host(authority(part(base, 2)))) & (host(authority(own)) != "") & (part(base, 1) != "")
    page = F.regexp_replace(page, r"(?i)/index\.(html?|php|aspx?)$", "/")
    return F.when(same & ~other & ~asset, F.concat(scheme, F.lit("//"), authority(own), page, asked))


def resolve_link(href: Column, base: Column) -> Column:
    """A link as its page means it, on any host: an absolute address, with its fragment; other schemes stay as they are."""
    part = lambda c, nth: F.regexp_extract(c, r"(?i)^(https?:)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$", nth)
    h = F.trim(href)
    scheme = F.lower(F.coalesce(F.nullif(part(h, 1), F.lit("")), part(base, 1)))
    absolute = F.regexp_like(h, F.lit("(?i)^(https?:)?//"))
    host = lambda c: F.concat(F.regexp_extract(c, "^(.*@)?", 1), F.regexp_replace(F.lower(F.regexp_replace(c, "^.*@", "")), F.when(scheme == "https:", ":443$").otherwise(":80$"), F.lit("")))
    own, path, query = F.when(absolute, part(h, 2)).otherwise(part(base, 2)), part(h, 3), part(h, 4)
    merged = F.when(absolute | path.startswith("/"), path).when(path == "", part(base, 3)).otherwise(F.concat(F.regexp_replace(part(base, 3), "[^/]*$", ""), path))
    asked = F.when(absolute | (path != "") | (query != ""), query).otherwise(part(base, 4))
    other = F.regexp_like(h, F.lit("(?i)^(?!https?:)[a-z][a-z0-9+.-]*:"))
    return F.when(other | (own == ""), h).otherwise(F.concat(scheme, F.lit("//"), host(own), _resolved(merged), asked, part(h, 5)))


def goes_somewhere(url: Column) -> Column:
    """Whether an address has a path or a query: a platform's bare home page is no one's menu."""
    return F.regexp_like(url, F.lit(r"(?i)^https?://[^/?#]*(/[^?#]|/?\?[^#])")) | F.regexp_like(url, F.lit("(?i)^(?!https?:)[a-z][a-z0-9+.-]*:.."))


def phone_item_id(item_id: Column) -> Column:
    """The number in an id such as `phone:tel:+90 532 123 45 67`."""
    return F.nullif(F.trim(found(item_id, r"(?i)phone:tel:(.+)$")), F.lit(""))


def strip_aria_prefix(label: Column) -> Column:
    """A label without its prefix, up to 24 characters and a colon; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(label, r"^[^:]{1,24}:\s*", ""), r"^\s+|\s+$", ""), F.lit(""))
