"""Menus: first-wins rows, headings as of a place, merging pages, promotion-last names, nesting and photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mezze.functions import scalars

# Names of categories that repeat products, and names that say nothing.
PROMO = r"(?iu)^(sezona [öo]zeller|[öo]ne [çc][ıi]kanlar|pop[üu]ler|şefin se[çc]imleri|f[ıi]rsatlar|kampanyalar|promosyonlar|en [çc]ok satanlar|featured|popular|top sellers|discounted)$"
GENERIC = r"(?iu)^(men[uü]|[uü]r[uü]nler|products|items|list[ea]?)$"
PORTIONS = r"(?<![a-z0-9])(kg|porsyon|servis|tek|duble|yarim|yrm|cl)(?![a-z0-9])"
ITEM = "struct<item_id:string,name:string,price:double,image:string>"


def first_by(rows: DataFrame, keys: list, order: list[str], tasks: int | None = None) -> DataFrame:
    """One row for each key, the least by `order`: an aggregation that combines before the shuffle, however hot a key is.

    Combining sorts all rows of a task, which is in vain where keys hardly repeat. With `tasks`, rows are dealt by key to so
    many tasks first, and sorted there only.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select(F.struct("*").alias("_row"), *[(F.col(k) if isinstance(k, str) else k).alias(n) for k, n in zip(keys, names)])
    by = F.struct(*[F.col(f"_row.{o}") for o in order])
    if tasks:
        keyed = keyed.repartition(tasks, *names)
    return keyed.groupBy(*names).agg(F.min_by("_row", by).alias("_row")).select("_row.*")


def heading_as_of(lines: DataFrame, is_heading: Column) -> DataFrame:
    """page, ord, line, heading of the lines that are no headings: the nearest heading above, null if there is none."""
    upto = Window.partitionBy("page").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("heading", F.last(F.when(is_heading, F.col("line")), ignorenulls=True).over(upto))
    return marked.filter(~is_heading).select("page", "ord", "line", "heading")


def normal_category(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))


def merge_pages(items: DataFrame, tasks: int | None = None) -> DataFrame:
    """Items of all pages of a venue: one category for each normalised name, one item for each name and price in it; first wins."""
    return first_by(items, ["venue_id", normal_category(F.col("category")), F.lower("name"), "price"], ["ord"], tasks)


def promotion_last(items: DataFrame, tasks: int | None = None) -> DataFrame:
    """One item for each product name of a venue: from a proper category if any has it, else from a promotion; first wins."""
    ranked = items.withColumn("_promo", F.regexp_like(F.trim("category"), F.lit(PROMO)).cast("int"))
    return first_by(ranked, ["venue_id", F.lower(F.trim("name"))], ["_promo", "ord"], tasks).drop("_promo")


def named_by_hint(items: DataFrame, tasks: int | None = None) -> DataFrame:
    """A page's only category, if its name says nothing, takes the hint of the link that led there (column title_hint).

    Items without a venue or page are left out. With `tasks`, pages are dealt to so many.
    """
    placed = items.filter("venue_id IS NOT NULL AND page IS NOT NULL")
    page = Window.partitionBy("venue_id", "page")
    known = (placed.repartition(tasks, "venue_id", "page") if tasks else placed).withColumns({"_lo": F.min("category").over(page), "_hi": F.max("category").over(page)})
    rename = (F.col("_lo") == F.col("_hi")) & F.col("title_hint").isNotNull() & F.regexp_like(F.trim("category"), F.lit(GENERIC))
    return known.withColumn("category", F.when(rename, F.substring("title_hint", 1, 80)).otherwise(F.col("category"))).drop("_lo", "_hi")


def variants(items: DataFrame) -> DataFrame:
    """venue_id, category, name, price (the least), n_variants of items with several prices under one name."""
    one = items.groupBy("venue_id", "category", "name").agg(F.min("price").alias("price"), F.count_distinct("price").alias("n_variants"))
    return one.filter("n_variants > 1")


def nested(items: DataFrame, tasks: int | None = None) -> DataFrame:
    """venue_id, categories: array of (category_id, name, items), categories and items in order of first appearance.

    With `tasks`, venues are dealt to so many, once for both levels.
    """
    if tasks:
        items = items.repartition(tasks, "venue_id")
    item = F.struct("ord", F.struct(scalars.short_id(F.concat_ws(":", "category", "name"), "item").alias("item_id"), "name", "price", "image").alias("item"))
    grouped = items.groupBy("venue_id", "category").agg(F.min("ord").alias("ord"), F.sort_array(F.collect_list(item)).alias("rows"))
    category = F.struct("ord", F.struct(scalars.short_id(F.col("category"), "cat").alias("category_id"), F.col("category").alias("name"), F.transform("rows", lambda r: r["item"]).alias("items")).alias("category"))
    return grouped.groupBy("venue_id").agg(F.sort_array(F.collect_list(category)).alias("rows")).select("venue_id", F.transform("rows", lambda r: r["category"]).alias("categories"))


def item_count(categories: Column) -> Column:
    return F.aggregate(categories, F.lit(0).cast("long"), lambda n, c: n + F.size(c["items"]))


def image_plan(items: DataFrame) -> DataFrame:
    """Distinct images with the address to fetch and the file name it will have."""
    url = scalars.optimize_image_url(F.col("image"))
    return items.filter("image IS NOT NULL").select("image", url.alias("target_url"), F.concat(F.lit("img_"), F.md5(url), F.lit(".webp")).alias("file_name")).distinct()


def pair_captions(posts: DataFrame, captions: DataFrame) -> DataFrame:
    """venue_id, nth, image_url, text of all posts: a venue's k-th post without a text of its own gets its k-th caption.

    Posts (venue_id, nth, image_url, text) whose text is missing or the site's stock phrase are without; the caption comes
    after what they say. Captions are venue_id, nth, text. Those left over on either side stay unpaired.
    """
    said = F.coalesce("text", F.lit(""))
    bare = (said == "") | F.contains(said, F.lit("Photo by")) | F.contains(said, F.lit("Video by"))
    place = F.row_number().over(Window.partitionBy("venue_id").orderBy("nth"))
    wanting = posts.filter(bare).withColumn("k", place)
    given = captions.select(F.col("venue_id").alias("c_venue"), place.alias("c_k"), F.col("text").alias("caption"))
    paired = wanting.join(given, F.col("venue_id").eqNullSafe(F.col("c_venue")) & (F.col("k") == F.col("c_k")), "left")
    text = F.when(F.col("caption").isNotNull(), F.concat(said, F.lit(" "), F.col("caption"))).otherwise(said)
    return paired.select("venue_id", "nth", "image_url", text.alias("text")).unionByName(posts.filter(~bare).select("venue_id", "nth", "image_url", "text"))


def match_photos(items: DataFrame, posts: DataFrame) -> DataFrame:
    """venue_id, ord, name, photo: items without an image and the first of their venue's posts that tells of them.

    A post tells of an item if it holds the whole folded name, or, portion words aside, three quarters of its words of more
    than two letters (its one word, if it has one only). Posts (venue_id, nth, image_url, text) meet items by venue.
    """
    told = posts.select("venue_id", F.struct("nth", F.col("image_url"), scalars.fold_text(F.col("text")).alias("text")).alias("post"))
    told = told.groupBy("venue_id").agg(F.sort_array(F.collect_list("post")).alias("posts"))
    folded = items.filter("image IS NULL").select("venue_id", "ord", "name", scalars.fold_text(F.col("name")).alias("folded"))
    bare = F.trim(F.regexp_replace("folded", PORTIONS, ""))
    named = folded.withColumn("bare", bare).withColumn("words", F.filter(F.split("bare", " "), lambda w: F.length(w) > 2))
    named = named.filter((F.length("folded") >= 3) & (F.length("bare") >= 3) & (F.size("words") > 0)).join(told, "venue_id")
    has = lambda text, w: F.contains(text, w)
    fits = lambda p: has(p["text"], F.col("folded")) | (F.size(F.filter("words", lambda w: has(p["text"], w))) * 4 >= F.size("words") * 3)
    hit = F.get(F.filter("posts", lambda p: (p["text"] != "") & fits(p)), F.lit(0))
    return named.select("venue_id", "ord", "name", hit["image_url"].alias("photo")).filter("photo IS NOT NULL")
