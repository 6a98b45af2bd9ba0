"""Noise by selectors and names, breadcrumbs and metadata, against plain walks over parsed pages."""

import random
import re

import pytest

from recordloom.dom import nodes as dom
from recordloom.dom import noise, regions, render
from tests.test_render import Walk, random_page

SF = "/root/testdata/sf0.001"


def fits(n, selector):
    _, tag, attr, kind, value = noise.parsed(selector)
    if tag and n["tag"] != tag:
        return False
    has = n[noise.ATTRIBUTES[attr]] if attr else ""
    return not attr or (kind == "is" and has == value) or (kind == "has" and value in has.split()) or (kind == "holds" and value in has)


def walk(rows):
    """(pre, selector) of what is noise, and the rows that are left."""
    out = {}
    for n in rows:
        first = next((s for s in noise.SELECTORS if n["tag"] != "#text" and fits(n, s)), None)
        if first:
            out[n["pre"]] = first
    inside = lambda n, some: any(p <= n["pre"] <= rows[p]["post"] for p in some)
    left = [n for n in rows if not inside(n, out)]
    kept = {n["pre"]: n for n in left}
    for n in left:
        name = f"{n['class']} {n['id']}"
        held = [x for x in left if n["pre"] < x["pre"] <= n["post"]]
        text = " ".join(x["raw"].strip() for x in held if x["tag"] == "#text")
        if n["tag"] != "#text" and name.strip() and re.search(noise.NAV_NAME, name) and not any(x["tag"] in regions.HEADINGS for x in held) and len(text) < 400 and not re.search(noise.SPEAKS_OF_COURSES, text):
            out[n["pre"]] = noise.NAMED
    return out, [n for n in kept.values() if not inside(n, out)]


PAGES = [
    "<body><nav>n</nav><div class='content'><p>keep</p><div class='menu'>x</div><div class='menu'><h2>kept</h2></div><div class='side-menu x'>unit of a course</div></div><p class='skip-link y'>s</p><p id='skip-link'>t</p></body>",
    "<body><a href='/portfolio_nopop.php?x'>Add</a><a href='/preview.php'>keep</a><div role='search'>q</div><div role='searching'>keep</div><div class='breadcrumbs'>b</div><div class='my-breadcrumbs'>c</div><form>f<p>g</p></form></body>",
    f"<body><div id='footer'>{'long text ' * 60}</div><div id='footer'>{'short ' * 20}</div><div class='navigate'>kept</div><div class='nav'><div class='share'>both</div></div></body>",
    "", None, "<p>x</p>",
]


def found(spark, pages):
    n = dom.nodes(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"))
    got = {}
    for r in noise.noise(n).collect():
        got.setdefault(r["page_id"], {})[r["pre"]] = r["selector"]
    left = {}
    for r in noise.cleaned(n).collect():
        left.setdefault(r["page_id"], []).append(r["pre"])
    return got, left


def noisy(r, page):
    """The page with some names and attributes put on its elements."""
    extra = ["class='menu'", "class='a breadcrumb b'", "id='skip-link'", "role='banner'", "class='nav'", "id='x'", "class='gateway-toolbar'", "class='content'", "class='social share'"]
    return re.sub(r"<(p|div|span|section|li|ul|b)>", lambda m: f"<{m[1]} {r.choice(extra)}>" if r.random() < 0.3 else m[0], page)


def test_noise_equals_a_walk(spark):
    r = random.Random(5)
    pages = PAGES + [noisy(r, f"<body>{random_page(r, 2)}</body>") for _ in range(80)]
    got, left = found(spark, pages)
    for k, page in enumerate(pages):
        want, rest = walk(dom.parse(page))
        assert got.get(k, {}) == want, page
        assert sorted(left.get(k, [])) == [n["pre"] for n in rest], page


def test_selectors_are_read_or_refused():
    assert noise.parsed("a[href*='x.php']") == ("a[href*='x.php']", "a", "href", "holds", "x.php")
    assert noise.parsed("div.c") == ("div.c", "div", "class", "has", "c") and noise.parsed("#i") == ("#i", "", "id", "is", "i")
    for bad in ("", "a b", "[style=x]", "a > b", ":hover"):
        with pytest.raises(ValueError, match="not supported"):
            noise.parsed(bad)


def test_noise_and_text_of_all_given_pages_equal_a_walk(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    n = dom.nodes(pages)
    got = {}
    for r in noise.noise(n).collect():
        got.setdefault(r["page_id"], {})[r["pre"]] = r["selector"]
    text = {r["page_id"]: r["text"] for r in render.rendered(noise.cleaned(n)).collect()}
    assert got
    for r in pages.collect():
        rows = dom.parse(r["html"])
        want, rest = walk(rows)
        assert got.get(r["page_id"], {}) == want
        assert text[r["page_id"]] == Walk(rest).text()


def test_breadcrumbs_in_their_order(spark):
    pages = [
        "<div class='breadcrumb'><a>Home</a> &gt; <a>Art</a></div><div id='breadcrumb'>Other</div><div aria-label='breadcrumb'>Other</div><a>Return to the list</a>",
        "<p>x</p><a>return to: Programs of Art</a><nav>n</nav>", "<p>Return to: <b>the</b> list of programs</p>", "<nav><a>One</a><a>Two</a><a>One</a></nav>", "<a>Return to</a><p>none</p>",
    ]
    n = dom.nodes(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"))
    assert {r["page_id"]: r["breadcrumb"] for r in regions.breadcrumb(n).collect()} == {0: "Home > Art | Other", 1: "return to: Programs of Art", 2: "Return to: the list of programs", 3: "One > Two", 4: "Return to: one"}


def test_metadata_of_pages(spark):
    pages = [
        "<head><title>Program: Art (BA) | Site</title></head><p>no unit here</p><p>Offered by the <b>Harwood College of Letters, Arts</b></p><p>Later School of Music</p>",
        "<h1>Physics, BS</h1><div>" + "long " * 60 + "School of Long Texts</div><div>University College</div><h2>Roland School</h2>", "<h1>Law (Minor)</h1>", "<p>x</p>",
    ]
    n = dom.nodes(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"))
    got = {r["page_id"]: (r["title"], r["credential"], r["school"]) for r in regions.metadata(n).collect()}
    assert got == {0: ("Art (BA)", "BA", "Harwood College of Letters, Arts"), 1: ("Physics, BS", "BS", "Roland School"), 2: ("Law (Minor)", "", None), 3: (None, None, None)}
