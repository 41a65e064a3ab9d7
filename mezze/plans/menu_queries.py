"""Queries over menu rows and lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from mezze.operators import menus as ops
from mezze.operators import pages
from mezze.plans.views import LINES, MENU_ROWS, line_stream, menu_rows, menu_tasks, table

_WITH = f"WITH {MENU_ROWS}"
#: The test menus' priorities stand for categories; two of them play promotions.
_RENAMED = {"1-URGENT": "Öne Çıkanlar", "5-LOW": " popular "}


def _dealt(s, d):
    """The menu rows, dealt to tasks of bounded rows, and how many tasks that is."""
    n = menu_tasks(s, d)
    return menu_rows(s, d, n), n


def _promoted(s, d):
    name = F.col("category")
    for old, new in _RENAMED.items():
        name = F.when(F.col("category") == old, new).otherwise(name)
    rows, n = _dealt(s, d)
    return ops.promotion_last(rows.withColumn("category", name), n)


def _hinted(s, d):
    rows, n = _dealt(s, d)
    items = rows.withColumn("category", F.when(F.col("page") % 4 == 0, "Menü").when(F.col("page") % 4 == 1, " PRODUCTS").otherwise(F.col("category")))
    hint = F.when(F.col("page") % 3 != 0, F.concat(F.lit("Hint "), F.col("page").cast("string")))
    return ops.named_by_hint(items.withColumn("title_hint", hint), n).select("ord", "category").repartition(n, "ord", "category").distinct()


def _posts(s, d):
    """Posts that tell of some of a venue's own items, and some that tell of nothing."""
    of = menu_rows(s, d).filter("ord % 7 = 0")
    text = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("BUGÜN: "), F.upper("name"), F.lit(" servis!"))).otherwise(F.lit("kg tek porsyon"))
    return of.select("venue_id", F.col("ord").alias("nth"), F.concat(F.lit("https://p.example/"), F.col("ord").cast("string")).alias("image_url"), text.alias("text"))


def _photos_sql() -> str:
    fold = "trim(regexp_replace(regexp_replace(translate(lower(translate({x}, 'İI', 'iı')), 'ğüşöçı', 'gusoci'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
    return f"""{_WITH}, posts AS (
  SELECT venue_id, ord AS nth, 'https://p.example/' || ord AS image_url, {fold.format(x="CASE WHEN ord % 2 = 0 THEN 'BUGÜN: ' || upper(name) || ' servis!' ELSE 'kg tek porsyon' END")} AS text FROM menu_rows WHERE ord % 7 = 0
), items AS (SELECT venue_id, ord, name, {fold.format(x='name')} AS folded, list_filter(string_split({fold.format(x='name')}, ' '), lambda w: length(w) > 2) AS words FROM menu_rows WHERE image IS NULL),
hits AS (SELECT i.venue_id, ord, name, min_by(image_url, nth) AS photo FROM items i JOIN posts p ON i.venue_id = p.venue_id AND length(folded) >= 3 AND len(words) > 0
  AND (contains(text, folded) OR len(list_filter(words, lambda w: contains(text, w))) * 4 >= len(words) * 3) GROUP BY ALL)
SELECT * FROM hits"""


def _image_sizes(s, d):
    """Two listings: every image as fetched, and three quarters of them as converted, some of those larger than before."""
    plan = ops.image_plan(menu_rows(s, d)).select(F.regexp_extract("file_name", "^(.*)[.]webp$", 1).alias("stem"), F.regexp_extract("image", "/([0-9]+)[.]jpg", 1).cast("long").alias("k"))
    originals = plan.select("stem", F.when(F.col("k") % 10 == 0, 0).otherwise(F.col("k") * 977 % 50_000 + 100).cast("long").alias("bytes"))
    converted = plan.filter("k % 4 <> 0").select("stem", (F.col("k") * 311 % 20_000).cast("long").alias("bytes"))
    return pages.image_savings(originals, converted)


_SIZES = f"""{_WITH}, k AS (SELECT DISTINCT regexp_extract(image, '/([0-9]+)[.]jpg', 1)::BIGINT AS k, 'img_' || md5('https://img.example/w_800,h_800,q_90/' || regexp_extract(image, '/([0-9]+)[.]jpg', 1) || '.jpg?w=800&q=90') AS stem FROM menu_rows WHERE image IS NOT NULL),
b AS (SELECT stem, CASE WHEN k % 10 = 0 THEN 0 ELSE k * 977 % 50000 + 100 END AS original_bytes, CASE WHEN k % 4 <> 0 THEN k * 311 % 20000 END AS webp_bytes FROM k),
sizes AS (SELECT *, webp_bytes IS NOT NULL AS converted, CASE WHEN original_bytes > 0 AND webp_bytes > 0 THEN original_bytes - webp_bytes ELSE 0 END AS bytes_saved,
  CASE WHEN webp_bytes IS NOT NULL THEN CASE WHEN original_bytes > 0 THEN floor((original_bytes - webp_bytes) / original_bytes::DOUBLE * 100e0 * 10e0 + 0.5e0) / 10e0 ELSE 0e0 END END AS savings_percent FROM b)"""


def _captions(s, d):
    """Posts of menu items, a third of them without a text and some with a stock phrase, and the names of other items as captions."""
    rows = menu_rows(s, d)
    text = F.when(F.col("ord") % 3 == 0, F.lit(None).cast("string")).when(F.col("ord") % 3 == 1, F.concat(F.lit("Photo by "), F.col("venue_id"))).otherwise(F.col("name"))
    posts = rows.filter("ord % 4 = 0").select("venue_id", F.col("ord").alias("nth"), F.concat(F.lit("https://p.example/"), F.col("ord").cast("string")).alias("image_url"), text.alias("text"))
    return ops.pair_captions(posts, rows.filter("ord % 9 = 0").select("venue_id", F.col("ord").alias("nth"), F.col("name").alias("text")))


_CAPTIONS = f"""{_WITH}, posts AS (SELECT venue_id, ord AS nth, 'https://p.example/' || ord AS image_url, CASE WHEN ord % 3 = 0 THEN NULL WHEN ord % 3 = 1 THEN 'Photo by ' || venue_id ELSE name END AS text FROM menu_rows WHERE ord % 4 = 0),
p AS (SELECT *, CASE WHEN text IS NULL OR contains(text, 'Photo by') THEN row_number() OVER (PARTITION BY venue_id, text IS NULL OR contains(text, 'Photo by') ORDER BY nth) END AS k FROM posts),
c AS (SELECT venue_id, name, row_number() OVER (PARTITION BY venue_id ORDER BY ord) AS k FROM menu_rows WHERE ord % 9 = 0)
SELECT p.venue_id, nth, image_url, CASE WHEN c.name IS NOT NULL THEN coalesce(text, '') || ' ' || c.name ELSE coalesce(text, '') END AS text FROM p LEFT JOIN c ON p.venue_id = c.venue_id AND p.k = c.k"""


def _nested(s, d):
    rows, tasks = _dealt(s, d)
    n = ops.nested(ops.merge_pages(rows, tasks), tasks)
    first = F.col("categories")[0]
    return n.select("venue_id", F.size("categories").cast("long").alias("n_categories"), ops.item_count(F.col("categories")).alias("n_items"), first["name"].alias("first_category"), first["category_id"].alias("first_id"), first["items"][0]["name"].alias("first_item"))


def _sets(s, d):
    return menu_rows(s, d).groupBy("venue_id").agg(F.array_join(F.array_sort(F.collect_set("category")), "|").alias("categories"))


_FIRST = "SELECT {columns} FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order}) = 1"
_COLUMNS = "venue_id, category, ord, name, price"
_SELECT = lambda df: df.select(*_COLUMNS.split(", "))
_RENAMED_SQL = "renamed AS (SELECT * REPLACE (CASE " + " ".join(f"WHEN category = '{a}' THEN '{b}'" for a, b in _RENAMED.items()) + " ELSE category END AS category) FROM menu_rows)"
_MERGED = "merged AS (" + _FIRST.format(columns="*", source="menu_rows", keys="venue_id, lower(category), lower(name), price", order="ord") + ")"

QUERIES = {
    "dedup_first": (lambda s, d: _SELECT(ops.first_by(menu_rows(s, d), ["venue_id", "name"], ["ord"])), f"{_WITH} " + _FIRST.format(columns=_COLUMNS, source="menu_rows", keys="venue_id, name", order="ord")),
    "heading_asof": (
        lambda s, d: ops.heading_as_of(line_stream(s, d), F.length("line") <= 40),
        f"WITH {LINES}, h AS (SELECT *, last_value(CASE WHEN length(line) <= 40 THEN line END IGNORE NULLS) OVER (PARTITION BY page ORDER BY ord) AS heading FROM lines) SELECT page, ord, line, heading FROM h WHERE length(line) > 40",
    ),
    "menu_merge": (lambda s, d: _SELECT(ops.merge_pages(*_dealt(s, d))), f"{_WITH}, {_MERGED} SELECT {_COLUMNS} FROM merged"),
    "menu_dedup": (
        lambda s, d: _SELECT(_promoted(s, d)),
        f"{_WITH}, {_RENAMED_SQL} " + _FIRST.format(columns=_COLUMNS, source="renamed", keys="venue_id, lower(trim(name, ' '))", order="category IN ('Öne Çıkanlar', ' popular '), ord"),
    ),
    "menu_title_hint": (
        _hinted,
        f"""{_WITH}, r AS (SELECT ord, page, venue_id, CASE WHEN page % 4 = 0 THEN 'Menü' WHEN page % 4 = 1 THEN ' PRODUCTS' ELSE category END AS category FROM menu_rows),
l AS (SELECT venue_id, page, min(category) AS lo, max(category) AS hi FROM r GROUP BY ALL)
SELECT DISTINCT ord, CASE WHEN lo = hi AND page % 3 <> 0 AND page % 4 < 2 THEN 'Hint ' || page ELSE category END AS category FROM r JOIN l USING (venue_id, page)""",
    ),
    "menu_nested": (
        _nested,
        f"""{_WITH}, {_MERGED}, first AS (SELECT venue_id, category, name FROM merged QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY ord) = 1)
SELECT venue_id, count(DISTINCT m.category) AS n_categories, count(*) AS n_items, any_value(f.category) AS first_category, 'cat_' || substr(md5(any_value(f.category)), 1, 8) AS first_id, any_value(f.name) AS first_item FROM merged m JOIN first f USING (venue_id) GROUP BY venue_id""",
    ),
    "variant_from_price": (lambda s, d: ops.variants(menu_rows(s, d)), f"{_WITH} SELECT venue_id, category, name, min(price) AS price, count(DISTINCT price) AS n_variants FROM menu_rows GROUP BY ALL HAVING count(DISTINCT price) > 1"),
    "categories_distinct": (_sets, f"{_WITH} SELECT venue_id, string_agg(DISTINCT category, '|' ORDER BY category) AS categories FROM menu_rows GROUP BY venue_id"),
    "image_plan": (
        lambda s, d: ops.image_plan(menu_rows(s, d)),
        f"{_WITH}, t AS (SELECT DISTINCT image, regexp_replace(regexp_replace(regexp_replace(image, '([?&])w=[0-9]+', '\\1w=800'), '([?&])q=[0-9]+', '\\1q=90'), '/w_[0-9]+,h_[0-9]+/', '/w_800,h_800,q_90/') AS target_url FROM menu_rows WHERE image IS NOT NULL) SELECT *, 'img_' || md5(target_url) || '.webp' AS file_name FROM t",
    ),
    "image_savings": (_image_sizes, f"{_SIZES} SELECT stem, original_bytes, webp_bytes, converted, bytes_saved, savings_percent FROM sizes"),
    "image_stats": (lambda s, d: pages.image_totals(_image_sizes(s, d)), f"{_SIZES} SELECT count(*) AS images, count(*) FILTER (converted) AS images_converted, coalesce(sum(bytes_saved), 0)::BIGINT AS bytes_saved FROM sizes"),
    "caption_pairs": (_captions, _CAPTIONS),
    "photo_match": (lambda s, d: ops.match_photos(menu_rows(s, d), _posts(s, d)).distinct(), _photos_sql()),
}
