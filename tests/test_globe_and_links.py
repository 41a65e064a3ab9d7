"""Distances on the whole sphere against all pairs, and addresses of menus and orders on written pages."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mezze.functions import scalars
from mezze.operators import pages, venues


def metres(a, b):
    (x1, y1), (x2, y2) = (map(math.radians, p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1.0, math.sqrt(h)))


def placed(spark, points):
    rows = [(str(i), p and {"type": "Point", "coordinates": list(p)}) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id string, location struct<type:string,coordinates:array<double>>")


def globe():
    rnd = random.Random(3)
    points = [(rnd.choice([-1, 1]) * rnd.uniform(179.5, 180), rnd.uniform(-60, 60)) for _ in range(60)]
    points += [(rnd.uniform(-180, 180), rnd.choice([-1, 1]) * rnd.uniform(89.5, 90)) for _ in range(60)]
    points += [(rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(60)]
    points += [(29 + rnd.gauss(0, 0.02), 41 + rnd.gauss(0, 0.02)) for _ in range(150)]  # a city
    return points + [(180.0, 0.0), (-180.0, 0.0), (0.0, 90.0), (77.0, 90.0), (0.0, -90.0), (0.0, 0.0), (0.0, 0.0), None]


@pytest.mark.parametrize("radius", [0.0, 300.0, 20_000.0, 1_500_000.0, 30_000_000.0])
def test_pairs_equal_all_pairs(spark, radius):
    points = globe() if radius < 1e7 else globe()[:70]
    want = {(str(i), str(j)) for i, a in enumerate(points) for j, b in enumerate(points) if a and b and i != j and metres(a, b) <= radius}
    rows = venues.nearest_pairs(placed(spark, points), placed(spark, points), radius).collect()
    got = [(r["id"], r["other_id"]) for r in rows]
    assert len(got) == len(set(got)) and set(got) == want
    assert want


@pytest.mark.parametrize("centre", [(179.99, 10.0), (-179.99, -45.0), (12.0, 89.9), (100.0, -89.9), (29.0, 41.0), (0.0, 90.0)])
def test_nearby_equals_all_distances(spark, centre):
    points = globe()
    want = [i for m, i in sorted((metres(centre, p), str(i)) for i, p in enumerate(points) if p and metres(centre, p) <= 100_000)][:200]
    got = [r["id"] for r in venues.nearby(placed(spark, points), centre[1], centre[0], radius_m=100_000, limit=200).collect()]
    assert sorted(got) == sorted(want)


def test_cells_follow_the_radius(spark):
    # Points of one half degree, apart by more than the radius: few of them meet in a cell.
    points = [(29 + x / 100, 41 + y / 100) for x in range(40) for y in range(40)]
    df = placed(spark, points)
    pairs = venues.nearest_pairs(df, df, 500.0)
    assert pairs.count() == 0
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


PAGES = [
    ("https://v.example/a/b?x=1", '<a href="https://finedine.com/">by</a><a href="https://menulux.com/v1">m</a>', ("Menulux", "https://menulux.com/v1"), []),
    ("https://x.qrmatic.link/", "<p>own</p><a href='https://menulux.com/v1'>m</a>", ("QrMatic", "https://x.qrmatic.link/"), []),
    ("https://v.example/", "finedine.com", ("FineDine", None), []),
    ("https://v.example/", "finedine.com and menulux.com", ("Menulux", None), []),
    ("https://v.example/", '{"u":"https:\\/\\/adisyo.com\\/q?id=1","w":"https:\\/\\/adisyo.com\\/z"}', ("Adisyo", "https://adisyo.com/q?id=1"), []),
    ("https://v.example/", '"https://l.instagram.com/?u=https%253A%252F%252Fmenum.app%252Fk"', ("Menum", "https://menum.app/k"), []),
    ("https://v.example/d/", '<a class="x" href=menuler/1>M</a><a HREF = "../menu-list">N</a>', ("Self-hosted", "https://v.example/menu-list"), []),
    ("https://v.example/", '<a href="/menus">M</a><a href="/dish-menu/">N</a>', None, []),
    ("https://v.example/", '<a href="//www.getir.com/yemek/r#now">G</a> ubereats.com <a href="/sepet">S</a>', None, [("GetirYemek", "https://www.getir.com/yemek/r#now"), ("UberEats", "https://v.example/"), ("Direct Web Order", "https://v.example/sepet")]),
    ("https://v.example/", None, None, []), (None, "menulux.com", ("Menulux", None), []), (None, None, None, []),
    ("https://v.example/", "<a>no address</a><a href=''>empty</a><a href='mailto:a@menulux.com'>mail</a>", ("Menulux", "mailto:a@menulux.com"), []),
]


def test_addresses_of_menus_and_channels(spark):
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _, _) in enumerate(PAGES)], "page_id long, url string, html string")
    for r in pages.menu_platforms(df).collect():
        _, _, menu, channels = PAGES[r["page_id"]]
        assert (r["has_qr_menu"], r["qr_menu_provider"], r["qr_menu_url"]) == ((True, *menu) if menu else (False, None, None)), PAGES[r["page_id"]]
        assert [tuple(c) for c in r["ordering_channels"]] == channels, PAGES[r["page_id"]]
    assert pages.menu_platforms(df.limit(0)).collect() == []


def test_links_resolve_on_any_host(spark):
    base = "http://User@V.example:80/a/b/c.html?q=1"
    said = {"d": "http://User@v.example/a/b/d", "../x/./y/": "http://User@v.example/a/x/y/", "?z": "http://User@v.example/a/b/c.html?z", "#f": "http://User@v.example/a/b/c.html?q=1#f", "//O.example": "http://o.example/", "HTTPS://O.example:443/p?r#s": "https://o.example/p?r#s", "/../../r": "http://User@v.example/r", "tel:+90": "tel:+90", "": "http://User@v.example/a/b/c.html?q=1"}
    rows = spark.createDataFrame([(h,) for h in said], "h string").select("h", scalars.resolve_link(F.col("h"), F.lit(base)).alias("u")).collect()
    assert {r["h"]: r["u"] for r in rows} == said
