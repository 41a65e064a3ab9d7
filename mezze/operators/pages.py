"""What captured pages say, by pattern: links, languages, contacts, platforms, structured data, sections and robots rules."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mezze.functions import scalars
from mezze.operators import menus

# Platforms, channels, means of payment, social sites and path words, in order of precedence.
QR_PLATFORMS = [
    ("Akınsoft", r"akinsoft\.com\.tr|qrmenuapp\.akinsoft"), ("KarekodApp", r"karekodapp\.com\.tr"), ("QrMatic", r"qrmatic\.link|qrmatic\.com"), ("FineDine", r"finedine(?:menu)?\.(?:co|com)|finedinemenu"),
    ("Menulux", r"menulux\.(?:com|net)"), ("Adisyo", r"adisyo\.com|qr\.adisyo"), ("MenuTown", r"menutown\.com"), ("Ordable", r"ordable\.(?:com|co)"), ("Menum", r"menum\.(?:com|app)"),
    ("Qmenu", r"qmenu\.(?:com|com\.tr)"), ("MenuDijital", r"menudijital\.com"), ("Menulog/QR", r"menulog\.com\.tr|qrmenu\.com\.tr"), ("Garsonum", r"garsonum\.com"), ("Nitro Menu", r"nitromenu\.(?:com|net)"),
    ("Sunmi/QRMenu", r"qrmenu|qr-menu|dijital-?menu|dijitalmenu"), ("PDF Menu", r"href=[\"'][^\"']*menu[^\"']*\.pdf"),
]
ORDER_CHANNELS = [
    ("Yemeksepeti", r"yemeksepeti\.com"), ("GetirYemek", r"getir\.com/(?:yemek|food)|getiryemek"), ("Trendyol Yemek", r"trendyol\.com/(?:yemek|go/yemek)"), ("Migros Yemek", r"migrosyemek\.com"),
    ("UberEats", r"ubereats\.com"), ("Deliveroo", r"deliveroo\.[a-z.]+"), ("Direct Web Order", r"href=[\"'][^\"']*/(?:siparis|order|sepet|checkout)\b"),
]
PAYMENTS = [
    ("Sodexo", "sodexo"), ("Multinet", "multinet"), ("SetCard", "set-?card"), ("Edenred", "edenred|ticket-?restaurant"), ("Metropol", "metropol-?card"), ("Paye", r"\bpaye\b"), ("Winwin", "win-?win"),
    ("Visa", r"\bvisa\b"), ("Mastercard", "master-?card"), ("Troy", r"\btroy\b"), ("Nakit", r"\bnakit\b"), ("Kredi Kartı", r"kredi\s*kart"), ("Yemek Kartı", r"yemek\s*(kart|çek|cek)"),
]
SOCIALS = [
    ("instagram", r"https?://(?:www\.)?instagram\.com/[A-Za-z0-9_.\-]+"), ("facebook", r"https?://(?:www\.)?facebook\.com/[A-Za-z0-9_.\-]+"), ("twitter", r"https?://(?:www\.)?(?:twitter|x)\.com/[A-Za-z0-9_.\-]+"),
    ("tiktok", r"https?://(?:www\.)?tiktok\.com/@[A-Za-z0-9_.\-]+"), ("youtube", r"https?://(?:www\.)?youtube\.com/(?:c/|channel/|@)[A-Za-z0-9_.\-]+"), ("whatsapp", r"https?://(?:api\.whatsapp\.com/send|wa\.me)/?[^\"'\s]*"),
]
BOILERPLATE = r"(?i)/(help|privacy|policies?|policy|terms|about|legal|login|signup|accounts?|sharer?|share|intent|explore|developers?|business|pages?/create)(/|$|\?)"
NEGATIVE = r"(?i)/(iletisim|contact|hakkimizda|hakkinda|about|blog|haber|news|gizlilik|privacy|kvkk|cerez|cookie|policy|terms|kosullar|sepet|cart|checkout|odeme|login|giris|uye|account|profil|rezervasyon|reservation|sube|branch|galeri|gallery|yorum|review|sss|faq|kariyer|career)\b"
POSITIVE = r"(?i)/(menu|menuler|kategori|kategoriler|category|categories|bolum|urunler|products|yemek|yemekler|icecek|drinks|food|tatli|dessert|pasta|dondurma|borek)\b"
POSITIVE_TEXT = r"(?iu)(menü|menu|kategori|bölüm|bolum|ürün|urun|yemek|içecek|icecek|kahvalt|tatlı|tatli|pide|kebap|pizza|burger|çorba|corba|salata|drink|food|dessert|starter|main|pasta|dondurma|börek|borek)"
SECTION_CLASS = r"(?iu)menu|kategori|category|section|bolum|bölüm|grid|tile|chart"
DAYS = r"(?iu)(pazartesi|salı|sali|çarşamba|carsamba|perşembe|persembe|cuma|cumartesi|pazar|monday|tuesday|wednesday|thursday|friday|saturday|sunday|hafta ?içi|hafta ?sonu|her ?gün)"
TIMES = r"[0-9]{1,2}[:.][0-9]{2}\s*[-–—/]\s*[0-9]{1,2}[:.][0-9]{2}"
LINK = r"(?is)<a\s[^>]*href\s*=[^>]*>.*?</a>"
EMAIL = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
#: An address, whole or not, with the word before it.
ADDRESSED = r"(?<![^\s<>])[^\s<>]{1,80}\s{1,9}[a-z0-9._%+-]+@[a-z0-9.-]+"


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in an opening tag, quoted or not; null without it."""
    of = lambda p: scalars.found(tag, rf"(?is)^[^>]*?\s{name}\s*=\s*{p}")
    return F.coalesce(of('"([^"]*)"'), of("'([^']*)'"), of("([^\"'\\s>]+)"))


def text_of(html: Column) -> Column:
    """Text between tags, scripts and styles aside, the usual entities decoded."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), "(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def links(pages: DataFrame) -> DataFrame:
    """page_id, page_url, nth, href, url (normalised, null if foreign), label, class, style, has_image: a row for each link."""
    tags = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(F.regexp_extract_all("html", F.lit(LINK), 0)).alias("nth", "a"))
    parts = tags.select("page_id", "page_url", "nth", attribute(F.col("a"), "href").alias("href"), attribute(F.col("a"), "class").alias("class"), attribute(F.col("a"), "style").alias("style"), F.regexp_like("a", F.lit("(?i)<img")).alias("has_image"), text_of(F.col("a")).alias("label"))
    return parts.withColumn("url", scalars.normalize_link(F.col("href"), F.col("page_url")))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^https?://[^/?#]+([^?#]*)", 1)


def section_links(pages: DataFrame, limit: int = 20) -> DataFrame:
    """page_id, nth, url, score: a menu page's links to its sections, best first.

    Signals add up; three points make a section. A link inside a better section's folder is left out, in order of rank.
    """
    same_class = Window.partitionBy("page_id", "class")
    found = links(pages).withColumn("n_class", F.when(F.coalesce("class", F.lit("")) != "", F.count("*").over(same_class)).otherwise(0))
    path, label = _path(F.col("url")), F.coalesce("label", F.lit(""))
    locale = r"(?i)^/[a-z]{2}/"
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    score = (
        points(F.regexp_like(path, F.lit(r"(?i)^/(?:[a-z]{2}/)?[0-9]{1,6}/?$")), 3) + points(F.regexp_like(path, F.lit(POSITIVE)), 3) + points(F.regexp_like(F.col("class"), F.lit(SECTION_CLASS)), 2)
        + points((label != "") & (F.length(label) <= 60) & F.regexp_like(label, F.lit(POSITIVE_TEXT)), 2) + points(F.col("n_class") >= 3, 2)
        + points(F.col("has_image") | F.regexp_like("style", F.lit("(?i)background-image")), 1) + points(F.size(F.filter(F.split(path, "/"), lambda s: s != "")) > 2, -2)
    )
    page_path = _path(F.col("page_url"))
    wanted = found.filter(F.col("url").isNotNull() & (F.col("url") != scalars.normalize_link(F.col("page_url"), F.col("page_url"))) & ~F.regexp_like(path, F.lit(NEGATIVE)))
    wanted = wanted.filter(~F.regexp_like(path, F.lit(locale)) | F.regexp_like(page_path, F.lit(locale))).withColumn("score", score).filter("score >= 3")
    best = wanted.groupBy("page_id", "url").agg(F.min(F.struct((-F.col("score")).alias("down"), F.col("nth"))).alias("b"))
    ranked = best.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("b.down", "b.nth", "url"))).alias("links"))

    def add(kept: Column, x: Column) -> Column:
        folder = lambda k: F.concat(F.regexp_replace(_path(k["url"]), "/+$", ""), F.lit("/"))
        inside = F.exists(kept, lambda k: (_path(x["url"]) != folder(k)) & F.startswith(_path(x["url"]), folder(k)))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("links", F.array().cast("array<struct<down:int,nth:int,url:string>>"), add)
    return ranked.select("page_id", F.inline(F.slice(kept, 1, limit))).select("page_id", "nth", "url", (-F.col("down")).alias("score"))


def languages(pages: DataFrame) -> DataFrame:
    """page_id, languages: sorted two-letter codes of the page, its alternates and links to translated copies."""
    html = F.col("html")
    codes = F.concat(
        F.array(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]+)", 1)),
        F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*?\shreflang\s*=\s*[\"']?([A-Za-z]+)"), 1),
        F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\shref\s*=\s*[\"']?(?:https?://[^/\"'>\s]+)?/([A-Za-z]{2})/"), 1),
    )
    return pages.select("page_id", F.array_sort(F.array_distinct(F.filter(F.transform(codes, lambda c: F.lower(c)), lambda c: F.regexp_like(c, F.lit("^[a-z]{2}$"))))).alias("languages"))


def titles(pages: DataFrame) -> DataFrame:
    raw = text_of(F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title>", 1))
    return pages.select("page_id", raw.alias("title"), scalars.clean_title(raw).alias("name"))


def profile_names(pages: DataFrame) -> DataFrame:
    """page_id, name: what structured data calls the site, else what its title says."""
    named = structured_profile(pages).select("page_id", F.col("name").alias("own"))
    return titles(pages).join(named, "page_id", "left").select("page_id", F.coalesce("own", "name").alias("name"))


def currency_of_site(pages: DataFrame, site: str = "site", order: str = "page_id", text: str = "html", default: str = "TRY") -> DataFrame:
    """site, currency: what the first page that states one says, in order; an aggregation that combines before the shuffle."""
    code = scalars.detect_currency(F.col(text), None)
    first = pages.select(site, F.col(order).alias("_at"), code.alias("_code")).groupBy(site).agg(F.min_by("_code", F.when(F.col("_code").isNotNull(), F.col("_at"))).alias("code"))
    return first.select(site, F.coalesce("code", F.lit(default)).alias("currency"))


def stored_files(spark, path: str) -> DataFrame:
    """stem, bytes of the files under a path or pattern: names without folder and ending; contents are not read."""
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return stored.select(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), F.col("length").alias("bytes"))


def image_savings(originals: DataFrame, converted: DataFrame) -> DataFrame:
    """stem, original_bytes, webp_bytes, converted, bytes_saved, savings_percent of two listings (stem, bytes), joined by stem.

    An image without a converted file counts as not converted and saves nothing, nor does one whose size is unknown or 0.
    """
    small = converted.select("stem", F.col("bytes").alias("webp_bytes"))
    both = originals.select("stem", F.col("bytes").alias("original_bytes")).join(small, "stem", "left")
    known = (F.col("original_bytes") > 0) & (F.col("webp_bytes") > 0)
    percent = (F.col("original_bytes") - F.col("webp_bytes")) / F.when(F.col("original_bytes") > 0, F.col("original_bytes")) * 100
    done = F.col("webp_bytes").isNotNull()
    saved = F.when(known, F.col("original_bytes") - F.col("webp_bytes")).otherwise(0)
    return both.select("stem", "original_bytes", "webp_bytes", done.alias("converted"), saved.alias("bytes_saved"), F.when(done, F.coalesce(F.floor(percent * 10 + 0.5) / 10, F.lit(0.0))).alias("savings_percent"))


def image_totals(savings: DataFrame) -> DataFrame:
    """images, images_converted, bytes_saved of all images."""
    return savings.agg(F.count("*").alias("images"), F.count_if("converted").alias("images_converted"), F.coalesce(F.sum("bytes_saved"), F.lit(0)).alias("bytes_saved"))


def image_storage(spark, path: str) -> DataFrame:
    """files, bytes of stored images under a path or pattern; contents are not read."""
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return stored.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def _named(html: Column, rules: list[tuple[str, str]]) -> Column:
    """Names of the rules whose pattern the page holds, in order."""
    return F.filter(F.array(*[F.when(F.regexp_like(html, F.lit("(?iu)" + p)), n) for n, p in rules]), lambda n: n.isNotNull())


def _emails(html: Column) -> Column:
    """E-mail addresses in lower case as the page has them, but for those that a title or heading is cut off within.

    Such a one ends a title or heading, and the same word goes before a longer address that begins with it.
    """
    tails = F.regexp_extract_all(html, F.lit(rf"(?i)({ADDRESSED})\s*</(?:title|h[1-6])\s*>"), 1)
    longer = lambda t: F.exists(F.regexp_extract_all(html, F.lit(f"(?i){ADDRESSED}"), 0), lambda o: F.startswith(o, t) & (F.length(F.rtrim(o, F.lit(".-"))) > F.length(t)))
    cut = F.transform(F.filter(tails, longer), lambda t: F.lower(F.regexp_extract(F.regexp_extract(t, r"(\S+)$", 1), EMAIL, 0)))
    said = F.transform(F.regexp_extract_all(html, F.lit(EMAIL), 0), lambda e: F.lower(e))
    times = lambda among, e: F.size(F.filter(among, lambda x: x == e))
    both = F.struct(said.alias("said"), cut.alias("cut"))
    return scalars.once(both, lambda b: F.when(F.size(b["cut"]) == 0, b["said"]).otherwise(F.filter(b["said"], lambda e: times(b["said"], e) > times(b["cut"], e))))


def site_scan(pages: DataFrame) -> DataFrame:
    """page_id, emails, phone_numbers, socials, qr_platform, ordering_channels, payment_methods of each page's html."""
    html = F.coalesce("html", F.lit(""))
    emails = _emails(html)
    phones = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)href\s*=\s*[\"']?tel:([^\"'>]+)"), 1), scalars.normalize_phone)
    social = F.struct(*[F.get(F.filter(F.regexp_extract_all(html, F.lit("(?i)" + p), 0), lambda u: ~F.regexp_like(u, F.lit(BOILERPLATE))), F.lit(0)).alias(n) for n, p in SOCIALS])
    return pages.select(
        "page_id", F.array_distinct(F.filter(emails, scalars.is_contact_email)).alias("emails"), F.array_distinct(F.filter(phones, lambda p: p.isNotNull())).alias("phone_numbers"), social.alias("socials"),
        F.get(_named(html, QR_PLATFORMS), F.lit(0)).alias("qr_platform"), _named(html, ORDER_CHANNELS).alias("ordering_channels"), _named(html, PAYMENTS).alias("payment_methods"),
    )


SELF_HOSTED = "Self-hosted"


def _head(values: Column) -> Column:
    return F.get(values, F.lit(0))


def menu_platforms(pages: DataFrame) -> DataFrame:
    """page_id, has_qr_menu, qr_menu_provider, qr_menu_url, ordering_channels (name, url) of pages (page_id, url, html).

    Platforms are asked in order. A page that lies on one is the menu itself. Else a platform's address is that of the
    first link to more than its home page, or the first address in the page's text, as scripts have it. The first platform
    with an address is the page's; without one the last platform found gives its name. Without any, a link to a menu on
    the page's own site counts. A channel's address is its first link, or the page. A page without html is judged by its
    url. All is said by column functions, row by row: nothing is shuffled.
    """
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    plain = lambda c: F.filter(c, lambda x: x.isNotNull())
    once = lambda df, *columns: df.select("page_id", "html", "url", F.inline(F.array(F.struct(*columns))))  # noqa: E731  a generator: what it makes is not worked out again by each rule
    p = pages.select("page_id", html.alias("html"), url.alias("url"))
    p = once(
        p, plain(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*>"), F.lit(0)), lambda t: attribute(t, "href"))).alias("hrefs"),
        F.transform(F.regexp_extract_all("html", F.lit(r"(?i)https?:\\?/\\?/[^\"'\s<>]+"), F.lit(0)), lambda x: F.struct(x.alias("href"), scalars.clean_url(x).alias("url"))).alias("texts"),
    )
    at = F.transform("hrefs", lambda h: F.struct(h.alias("href"), scalars.resolve_link(h, F.col("url")).alias("url")))
    p = once(p, at.alias("links"), "texts")
    holds = lambda c, pattern: F.regexp_like(c, F.lit(f"(?iu){pattern}"))
    fit = lambda name, pattern: _head(F.filter(name, lambda x: holds(x["href"], pattern) & scalars.goes_somewhere(x["url"])))

    def found(name: str, pattern: str) -> Column:
        own, said = holds(F.col("url"), pattern), _head(F.filter("texts", lambda x: holds(x["href"], pattern)))["url"]
        menu = F.when(own, F.col("url")).otherwise(F.coalesce(scalars.clean_url(fit("links", pattern)["url"]), F.when(scalars.goes_somewhere(said), said)))
        return F.when(own | holds(F.col("html"), pattern), F.struct(F.lit(name).alias("name"), menu.alias("url")))

    def channel(name: str, pattern: str) -> Column:
        link = _head(F.filter("links", lambda x: holds(x["href"], pattern) | holds(F.concat(F.lit('href="'), x["href"], F.lit('"')), pattern)))
        return F.when(holds(F.col("html"), pattern), F.struct(F.lit(name).alias("name"), F.coalesce(link["url"], F.col("url")).alias("url")))

    menu_link = _head(F.filter("links", lambda x: holds(x["href"], r"/(menu|menu-?list|menuler|menü)(?![A-Za-z0-9_])")))
    own = F.when(menu_link.isNotNull(), F.struct(F.lit(SELF_HOSTED).alias("name"), menu_link["url"].alias("url")))
    listed = lambda make, rules: F.array_compact(F.array(*[make(*r) for r in rules]))
    p = once(p, listed(found, QR_PLATFORMS).alias("found"), listed(channel, ORDER_CHANNELS).alias("channels"), own.alias("own"))
    named = F.coalesce(_head(F.filter("found", lambda f: f["url"].isNotNull())), F.try_element_at("found", F.lit(-1)), "own")
    chosen = p.select("page_id", named.alias("menu"), "channels")
    return chosen.select("page_id", F.col("menu").isNotNull().alias("has_qr_menu"), F.col("menu.name").alias("qr_menu_provider"), F.col("menu.url").alias("qr_menu_url"), F.col("channels").alias("ordering_channels"))


def opening_lines(pages: DataFrame) -> DataFrame:
    """page_id, hours: lines of at most 90 characters with a weekday and a range of times, distinct, 14 at most."""
    lines = F.transform(F.split(F.regexp_replace("html", r"(?i)<(br|/p|/li|/tr|/div|/h[1-6])\b[^>]*>", "\n"), "\n"), text_of)
    hours = F.filter(lines, lambda x: (F.length(x) <= 90) & F.regexp_like(x, F.lit(DAYS)) & F.regexp_like(x, F.lit(TIMES)))
    return pages.select("page_id", F.slice(F.array_distinct(hours), 1, 14).alias("hours"))


def _numbered(pages: DataFrame) -> DataFrame:
    """page_id, html, row: a number for each row, so that each capture of a page that has more than one is read by itself."""
    return pages.select("page_id", "html", F.monotonically_increasing_id().alias("row"))


def structured(pages: DataFrame) -> DataFrame:
    """page_id, row, nth, node (variant): JSON-LD nodes of a page, graphs and lists opened; blocks that are not JSON are left out."""
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    parsed = _numbered(pages).select("page_id", "row", F.posexplode(blocks).alias("block", "json")).select("page_id", "row", "block", F.try_parse_json("json").alias("v")).filter("v IS NOT NULL")
    tops = F.coalesce(F.try_variant_get("v", "$.@graph", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    nodes = parsed.select("page_id", "row", "block", F.posexplode(tops).alias("at", "node"))
    place = F.row_number().over(Window.partitionBy("page_id", "row").orderBy("block", "at")) - 1
    return nodes.select("page_id", "row", place.alias("nth"), "node")


def _text(node, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def _many(node, path: str) -> Column:
    """What stands at a path, as an array: a list's members, or the one thing there is."""
    return F.coalesce(F.try_variant_get(node, path, "array<variant>"), F.array_compact(F.array(F.try_variant_get(node, path, "variant"))))


def _walk(menus):
    """Items of each menu in the order of its sections, sections within sections to any depth; an own stack, so depth costs no recursion."""
    many = lambda node, key: [] if not isinstance(node, dict) or key not in node else node[key] if isinstance(node[key], list) else [node[key]]
    inner = lambda s: many(s, "hasMenuSection") + many(s, "menuSection")
    for batch in menus:
        rows = []
        for page_id, row, nth, m, menu in zip(batch["page_id"], batch["row"], batch["nth"], batch["m"], batch["menu"]):
            top = json.loads(menu)
            # A menu that has sections is not read itself.
            todo, i = inner(top)[::-1] or [top], 0
            while todo:
                section = todo.pop()
                name = section.get("name") if isinstance(section, dict) else None
                for item in many(section, "hasMenuItem") or many(section, "menuItem"):
                    rows.append((page_id, row, nth, m, i, json.dumps(name), json.dumps(item)))
                    i += 1
                if section is not top:
                    todo += inner(section)[::-1]
        yield pd.DataFrame(rows, columns=["page_id", "row", "nth", "m", "i", "section", "item"])


def structured_menu(pages: DataFrame) -> DataFrame:
    """page_id, category, ord, name, price, currency of JSON-LD menus: sections, and sections within them at any depth.

    Only menus reach Python, which opens their sections. Pages without a menu have no rows. A price is a whole field, so
    it is read strictly, however many digits it has in a row.
    """
    nodes = structured(pages)
    is_menu = _text(F.col("node"), "$.@type") == "Menu"
    menus = nodes.select("page_id", "row", "nth", F.posexplode(F.when(F.try_variant_get("node", "$.hasMenu", "variant").isNotNull(), _many(F.col("node"), "$.hasMenu")).when(is_menu, F.array("node"))).alias("m", "menu"))
    key = dict(pages.dtypes)["page_id"]
    found = menus.select(F.col("page_id").cast("string").alias("page_id"), "row", "nth", "m", F.to_json("menu").alias("menu")).mapInPandas(_walk, "page_id string, row long, nth int, m int, i int, section string, item string")
    items = found.select(F.col("page_id").cast(key).alias("page_id"), "row", "nth", "m", "i", F.coalesce(_text(F.parse_json("section"), "$"), F.lit("Menü")).alias("category"), F.parse_json("item").alias("item"))
    offer = F.get(_many(F.col("item"), "$.offers"), F.lit(0))
    rows = items.select("page_id", "row", "category", "nth", "m", "i", _text(F.col("item"), "$.name").alias("name"), F.coalesce(scalars.parse_price(_text(offer, "$.price"), strict=True), F.lit(0.0)).alias("price"), F.coalesce(_text(offer, "$.priceCurrency"), F.lit("TRY")).alias("currency")).filter("name IS NOT NULL")
    return rows.select("page_id", "category", (F.row_number().over(Window.partitionBy("page_id", "row").orderBy("nth", "m", "i")) - 1).alias("ord"), "name", "price", "currency")


def structured_profile(pages: DataFrame) -> DataFrame:
    """page_id, name, address, phone, lat, lng: the first business node of a page's JSON-LD that has each."""
    of = structured(pages).filter(F.regexp_like(_text(F.col("node"), "$.@type"), F.lit("(?i)restaurant|cafe|bakery|bar|food|localbusiness|organization|store")))
    address = F.coalesce(_text(F.col("node"), "$.address.streetAddress"), F.lit(None).cast("string"))
    whole = F.when(F.schema_of_variant(F.try_variant_get("node", "$.address", "variant")) == "STRING", _text(F.col("node"), "$.address")).otherwise(F.concat_ws(", ", address, *[_text(F.col("node"), f"$.address.{p}") for p in ("addressLocality", "addressRegion", "postalCode", "addressCountry")]))
    rows = of.select("page_id", "nth", _text(F.col("node"), "$.name").alias("name"), F.nullif(whole, F.lit("")).alias("address"), _text(F.col("node"), "$.telephone").alias("phone"), F.try_variant_get("node", "$.geo.latitude", "double").alias("lat"), F.try_variant_get("node", "$.geo.longitude", "double").alias("lng"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("nth"))).alias(c)
    return rows.groupBy("page_id").agg(*[first(c) for c in ("name", "address", "phone", "lat", "lng")])


# Fields of product objects in embedded JSON, in order of precedence.
NAMES = ("name", "title", "productName", "label")
OWNERS = ("name", "title", "categoryName", "category_name", "categoryTitle", "headline", "display_name", "label")
PRICED = ("price", "unit_price", "price_after_discount", "priceObject")
PRICES = ("price", "unit_price", "price_after_discount", "priceBeforeDiscount", "priceObject.price", "price.amount", "price.value", "price.price")
PICTURED = ("fileUrl", "imageUrl", "image", "logoUrl", "photo", "avatar", "src")
DESCRIBED = ("description", "desc", "short_description")
MENU_KEYS = ("categories", "menuCategories", "menu")


def _first(node, names, least: int, most: int) -> Column:
    """The first of the string fields that says something, if its length is in bounds."""
    said = F.coalesce(*[F.nullif(F.when(F.schema_of_variant(F.try_variant_get(node, f"$.{n}", "variant")) == "STRING", _text(node, f"$.{n}")), F.lit("")) for n in names])
    return F.when(F.length(said).between(least, most), F.trim(F.regexp_replace(said, r"\s+", " ")))


def _is_product(node) -> Column:
    has = lambda names: F.coalesce(*[F.try_variant_get(node, f"$.{n}", "variant") for n in names]).isNotNull()
    kind = (F.coalesce(_text(node, "$.type"), F.lit("")) == "product") | F.contains(F.lower(F.coalesce(_text(node, "$.__typename"), F.lit(""))), F.lit("product")) | has(("productId", "product_id"))
    return _first(node, NAMES, 2, 150).isNotNull() & (has(PRICED) | has(PICTURED) | has(DESCRIBED) | kind)


def embedded_menu(pages: DataFrame, depth: int = 12) -> DataFrame:
    """page_id, category, ord, name, price, currency of products in a page's embedded JSON, whatever its shape.

    Lists with products are looked for down to `depth`; a product's category is its own, else its list owner's title, else the
    one above. State and captured payloads are read; other JSON only if there are none. One row for each category and name of a row,
    the first by place (fields in order of name).
    """
    script = lambda mark: F.regexp_extract_all("html", F.lit(rf"(?is)<script\b(?=[^>]*(?:{mark}))[^>]*>(.*?)</script>"), 1)
    own, other = script("__NEXT_DATA__|captured"), F.filter(script("application/json"), lambda x: F.length(x) >= 50)
    level = _numbered(pages).select("page_id", "row", F.posexplode(F.when(F.size(own) > 0, own).otherwise(other)).alias("b", "json"))
    level = level.select("page_id", "row", F.array("b").alias("at"), F.try_parse_json("json").alias("v"), F.lit("Menü").alias("title"), F.lit(False).alias("done")).filter("v IS NOT NULL")
    node = lambda at, v, title, done: F.struct(at.alias("at"), v.alias("v"), title.alias("title"), F.lit(done).alias("done"))
    members = lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    deeper = lambda n: n["done"] | F.regexp_like(F.schema_of_variant(n["v"]), F.lit("^(OBJECT|ARRAY)"))
    # One step down for each level: products that are found stay as they are, other objects and lists give what is in them.
    for d in range(depth + 1):

        def field(e: Column, k: Column) -> Column:
            of = F.coalesce("owner", "title")
            here = F.filter(F.transform(members(e["value"]), lambda x, i: node(F.concat("at", F.array(k, i)), x, of, True)), lambda n: _is_product(n["v"]))
            named = F.lit(d > 1) | e["key"].isin(*MENU_KEYS)  # noqa: B023
            return F.concat(here, F.array(node(F.concat("at", F.array(k)), e["value"], F.when(named, of).otherwise(F.col("title")), False)))

        entries = F.coalesce(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
        listed = F.transform(members(F.col("v")), lambda x, i: node(F.concat("at", F.array(i)), x, F.col("title"), False))
        below = F.filter(F.concat(F.flatten(F.transform(entries, field)), listed), deeper)
        same = F.array(F.struct("at", "v", "title", "done"))
        level = level.withColumn("owner", F.when(~F.col("done"), _first(F.col("v"), OWNERS, 2, 90))).select("page_id", "row", F.inline(F.when(F.col("done"), same).otherwise(below)))
    products = level.filter("done").select("page_id", "row", "at", "title", F.col("v").alias("p"))
    p = F.col("p")
    number = lambda n: F.when(F.schema_of_variant(F.try_variant_get(p, f"$.{n}", "variant")) != "STRING", F.try_variant_get(p, f"$.{n}", "double"))
    price = F.coalesce(*[number(n) for n in PRICES], scalars.parse_price(_text(p, "$.price"), strict=True), F.lit(0.0))
    category = F.coalesce(_first(p, ("categoryName", "category_name", "category"), 2, 90), F.col("title"))
    rows = products.select("page_id", "row", "at", category.alias("category"), _first(p, NAMES, 2, 150).alias("name"), price.alias("price"), F.coalesce(_text(p, "$.currency"), F.lit("TRY")).alias("currency"))
    first = rows.groupBy("page_id", "row", F.lower("category").alias("_c"), F.lower("name").alias("_n")).agg(F.min_by(F.struct("at", "category", "name", "price", "currency"), "at").alias("r")).select("page_id", "row", "r.*")
    return first.select("page_id", "category", (F.row_number().over(Window.partitionBy("page_id", "row").orderBy("at")) - 1).alias("ord"), "name", "price", "currency")


def page_menu(pages: DataFrame) -> DataFrame:
    """Menu rows of each page with their method: structured data if it has any, else embedded JSON."""
    one = structured_menu(pages).withColumn("method", F.lit("schema_org"))
    two = embedded_menu(pages).withColumn("method", F.lit("next_data_json"))
    return one.unionByName(two.join(one.select("page_id").distinct(), "page_id", "left_anti"))


def menu_result(pages: DataFrame) -> DataFrame:
    """venue_id (the host), category, name, price, method: pages' menus merged, promotions last."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", r"(?i)^https?://([^/?#:]+)", 1)), r"^www\.", "")
    items = page_menu(pages).join(pages.select("page_id", host.alias("venue_id")), "page_id")
    merged = menus.promotion_last(menus.merge_pages(items.withColumn("ord", F.struct("page_id", "ord")))).select("venue_id", "category", "name", "price", "method")
    methods = menu_methods(merged, "venue_id").select("venue_id", F.col("method").alias("summary"))
    return merged.drop("method").join(methods, "venue_id").withColumnRenamed("summary", "method")


def menu_methods(menu: DataFrame, key: str = "page_id") -> DataFrame:
    """key, method, warnings: structured data only if no other method found anything; prices of 0 are told of."""
    other = F.min(F.when(F.col("method") != "schema_org", F.col("method")))
    unpriced = F.count(F.when(F.col("price") == 0, 1))
    return menu.groupBy(key).agg(F.coalesce(other, F.lit("schema_org")).alias("method"), F.when(unpriced > 0, F.concat(unpriced.cast("string"), F.lit(" products without a price"))).alias("warnings"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """origin, prefix, allow: rules for every agent (`*`). Agent lines in a row share the group that follows them."""
    line = lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))
    lines = F.filter(F.transform(F.split("body", r"\r?\n"), line), lambda x: F.locate(":", x) > 0)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("field"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    start = F.struct(F.lit(False).alias("open"), F.lit(False).alias("naming"), F.array().cast("array<struct<prefix:string,allow:boolean>>").alias("rules"))

    def step(s: Column, x: Column) -> Column:
        agent = x["field"] == "user-agent"
        opened = F.when(agent, (s["naming"] & s["open"]) | (x["value"] == "*")).otherwise(s["open"])
        rule = s["open"] & x["field"].isin("allow", "disallow") & (x["value"] != "")
        added = F.array(F.struct(x["value"].alias("prefix"), (x["field"] == "allow").alias("allow")))
        return F.struct(opened.alias("open"), agent.alias("naming"), F.when(rule, F.concat(s["rules"], added)).otherwise(s["rules"]).alias("rules"))

    return robots.select("origin", F.aggregate(pairs, start, step)["rules"].alias("rules")).select("origin", F.inline("rules"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, allowed: the longest prefix decides, an allowing one at equal length; without a rule a page is allowed.

    Rules meet pages by origin, an equi-join; prefixes are compared within.
    """
    parts = urls.select("url", F.lower(F.regexp_extract("url", r"(?i)^(https?://[^/?#]+)", 1)).alias("origin"), _path(F.col("url")).alias("path"))
    named = rules.select(F.lower("origin").alias("origin"), "prefix", "allow")
    hits = parts.join(named, (parts["origin"] == named["origin"]) & parts["path"].startswith(named["prefix"]), "left")
    best = hits.groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("verdict"))
    return best.select("url", F.coalesce("verdict", F.lit(True)).alias("allowed"))


def crawl_plan(entries: DataFrame, captured: DataFrame, rules: DataFrame, budget: int = 20) -> DataFrame:
    """page_id, url, state: an entry page's sections under the budget, as captured, missing or barred by robots rules."""
    wanted = section_links(entries, budget).select("page_id", "url")
    allowed = robots_allowed(wanted.select("url").distinct(), rules)
    have = captured.select("url").distinct().withColumn("have", F.lit(True))
    state = F.when(~F.col("allowed"), "barred").when(F.col("have"), "captured").otherwise("missing")
    return wanted.join(allowed, "url").join(have, "url", "left").select("page_id", "url", state.alias("state"))
