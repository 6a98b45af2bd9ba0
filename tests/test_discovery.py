"""Regions, boundaries and links against plain walks over the parsed pages, and the cases that must fail loudly."""

import math
import re

import pytest
from pyspark.sql import functions as F

from recordloom.dom import discovery, regions
from recordloom.dom import nodes as dom
from recordloom.sources.shared import settled

URL = "https://site.example.org/a/list.php"
PROGRAMS = '<a href="preview_program.php?catoid=1&poid={0}&utm_x=1">P{0}</a>'
NAV = '<nav><h2>Programs</h2><a href="preview_program.php?catoid=1&poid=99">N</a></nav>'
TEXT = "<p>" + "words of the page " * 30 + "</p>"
PAGES = [
    # heading in the navigation is no target; the wrapping anchor belongs to the next section; repeats count once
    (1, f"<body><main>{NAV}{TEXT}<h2>• Programs:</h2>{PROGRAMS.format(5)}{PROGRAMS.format(6)}{PROGRAMS.format(5)}<h3>Minor</h3>{PROGRAMS.format(7)}<a href='preview_program.php?catoid=1&poid=8'><h2>Other</h2></a>{PROGRAMS.format(9)}</main></body>"),
    # the end of a region ends the section
    (2, f"<body><td class='x block_content y'>{TEXT}<div role='heading' aria-level='x'>PROGRAMS</div>{PROGRAMS.format(5)}</td></body>"),
    # the end of a page does not
    (3, f"<body>{TEXT}<h2>Programs</h2>{PROGRAMS.format(5)}</body>"),
    # no heading but labels in bold
    (4, f"<body><article>{TEXT}<p><b>Programs</b></p>{PROGRAMS.format(5)}<p>and <b>Programs</b></p>{PROGRAMS.format(6)}<p><strong>Next</strong></p>{PROGRAMS.format(7)}</article></body>"),
    # a class ends no section that a tag began
    (5, f"<body><main>{TEXT}<h2>Programs</h2>{PROGRAMS.format(5)}<p class='filter-heading'>Filter</p>{PROGRAMS.format(6)}<h1>End</h1>{PROGRAMS.format(7)}</main></body>"),
    (6, f"<body><main>{TEXT}<h2>Else</h2></main></body>"),
    (7, ""),
    (8, None),
]


@pytest.fixture(scope="module")
def found(spark):
    pages = spark.createDataFrame([(i, URL, h) for i, h in PAGES], "page_id int, url string, html string")
    links, sections = discovery.discover(settled(dom.nodes(pages)), pages, F.col("form") == "programs")
    return links.collect(), {r["page_id"]: r for r in sections.collect()}


def test_links_of_the_section(found):
    got = {}
    for r in sorted(found[0], key=lambda r: (r["page_id"], r["seq"])):
        got.setdefault(r["page_id"], []).append((r["seq"], r["poid"], r["title"]))
    assert got == {
        1: [(1, "5", "P5"), (2, "6", "P6"), (3, "7", "P7")], 2: [(1, "5", "P5")], 4: [(1, "5", "P5"), (2, "6", "P6")], 5: [(1, "5", "P5"), (2, "6", "P6")],
    }
    assert all(r["canonical"] == f"https://site.example.org/a/preview_program.php?catoid=1&poid={r['poid']}" for r in found[0])


def test_sections_and_errors(found):
    s = found[1]
    assert sorted(s) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [(s[k]["ended_by"], s[k]["stop_heading"], s[k]["source"], s[k]["error"]) for k in (1, 2, 4, 5)] == [
        ("heading", "Other", "native", None), ("container", None, "role", None), ("heading", "Next", "label", None), ("heading", "End", "native", None),
    ]
    assert {k: s[k]["error"] for k in (3, 6, 7, 8)} == {3: "boundary_not_provable", 6: "boundary_not_provable", 7: "content_region_missing", 8: "content_region_missing"}
    assert (s[1]["n_links"], s[1]["duplicates"], s[3]["n_links"]) == (3, 1, 0)


def test_strict_region(spark):
    chrome = "<header>site</header>"
    pages = [
        (1, f"<body>{chrome}<main>{chrome}{TEXT}</main><td class='block_content'>{TEXT}</td></body>"), (2, f"<body>{chrome}<div id='z'><h1>T</h1>{TEXT}</div></body>"), (3, f"<body>{chrome}<main>{chrome}{TEXT}</main></body>"),
        (4, f"<body><main>Skip to content {TEXT}</main></body>"), (5, f"<body><div><h1 id='acalog-content'>T</h1>{TEXT}</div></body>"),
    ]
    n = dom.nodes(spark.createDataFrame(pages, "page_id int, html string"))
    got = {r["page_id"]: (r["label"], r["o_tag"], r["error"]) for r in discovery.region(discovery.regions(n), strict=True).collect()}
    assert got == {1: ("td.block_content", "td", None), 2: ("around h1", "div", None), 3: (None, None, "content_region_missing"), 4: (None, None, "content_region_missing"), 5: ("#acalog-content", "div", None)}


def test_a_landmark_with_most_text_stays(spark):
    n = dom.nodes(spark.createDataFrame([(1, f"<div><aside>{TEXT}</aside><p>short</p><div class='menu'>m</div></div>")], "page_id int, html string"))
    left = discovery.navigation_free(n.where("pre > 0")).collect()
    assert {"aside", "p"} <= {r["tag"] for r in left} and "m" not in {r["text"] for r in left}


def _held(rows, n):
    return rows[n["pre"] + 1 : n["post"] + 1]


def _line(rows, n):
    return " ".join(x["text"] for x in _held(rows, n) if x["tag"] == "#text")


def _length(rows, n):
    return len(_line(rows, n))


def _score(rows, n):
    held, length = _held(rows, n), _length(rows, n)
    if not length:
        return -1000.0
    count = lambda *tags: sum(x["tag"] in tags for x in held)
    links = sum(_length(rows, x) for x in held if x["tag"] == "a")
    out = math.log(length + 1) * 12 + 6 * count(*regions.HEADINGS) + 0.6 * min(count("li"), 200) + 5 * count("table") + 40 * min(count("h1"), 1) + 2 * min(sum("acalog" in x["class"].lower() for x in held), 50)
    out -= 80 * (links > 0.85 * length) + 120 * bool(re.search(discovery.NAV_NAME, " ".join([n["class"], n["id"]]))) + 30 * (n["tag"] in ("body", "html"))
    return out


@pytest.fixture(scope="module")
def parsed(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    return settled(dom.nodes(pages)), {r["page_id"]: dom.parse(r["html"]) for r in pages.collect()}


def test_region_scores_equal_a_walk(parsed):
    nodes, walks = parsed
    rows = discovery.regions(nodes).collect()
    assert len({r["page_id"] for r in rows}) == len(walks)
    for r in rows:
        page = walks[r["page_id"]]
        n = page[r["o_pre"]]
        assert (r["o_tag"], r["length"]) == (n["tag"], _length(page, n)) and math.isclose(r["score"], _score(page, n))


def test_headings_and_links_equal_a_walk(parsed):
    nodes, walks = parsed
    heads, links = [], []
    for k, page in walks.items():
        heads += [(k, n["pre"], int(n["tag"][1]), _line(page, n)) for n in page if n["tag"] in regions.HEADINGS and _line(page, n)]
        once = {n["href"]: n for n in reversed(page) if n["tag"] == "a" and n["href"]}
        links += [(k, i, n["href"], _line(page, n)) for i, n in enumerate(sorted(once.values(), key=lambda n: n["pre"]), 1)]
    assert sorted((r["page_id"], r["o_pre"], r["hl"], r["heading"]) for r in regions.headings(nodes).collect()) == sorted(heads)
    assert sorted((r["page_id"], r["seq"], r["href"], r["title"]) for r in regions.links(nodes).collect()) == sorted(links)


def test_candidates_locators_and_breadcrumbs_equal_a_walk(parsed):
    nodes, walks = parsed
    for r in regions.candidates(nodes).collect():
        held = _held(walks[r["page_id"]], walks[r["page_id"]][r["o_pre"]])
        assert r["chars"] == sum(len(x["text"]) for x in held) and r["chrome"] == sum(x["tag"] in regions.CHROME for x in held) and r["items"] == sum(x["tag"] == "li" for x in held)
    for r in regions.locators(nodes).collect():
        page, at, path = walks[r["page_id"]], r["pre"], []
        while at >= 0:
            n = page[at]
            path.append(n["tag"] + ("#" + n["id"] if n["id"] else "") + ("." + n["class"].split(" ")[0] if n["class"] else ""))
            at = n["parent"]
        assert r["path"] == " > ".join(reversed(path[:12]))
    crumbs = {r["page_id"]: r["breadcrumb"] for r in regions.breadcrumb(nodes).collect()}
    for k, page in walks.items():  # the given pages have no trail and say nowhere where to return to
        assert not any("breadcrumb" in n["class"] or "Return to" in n["text"] for n in page)
        n = next((n for n in page if n["tag"] == "nav"), None)
        line = list(dict.fromkeys(x["text"] for x in _held(page, n) if x["tag"] == "#text")) if n else []
        assert crumbs.get(k, "") == " > ".join(line)[:400]


def test_locators_of_a_very_deep_page(spark):
    page = "<div>" * 3000 + "<p id='x'>t</p>"
    got = {r["pre"]: r["path"] for r in regions.locators(dom.nodes(spark.createDataFrame([(1, page)], "page_id int, html string"))).collect()}
    assert len(got) == 3001 and got[3000] == " > ".join(["div"] * 11 + ["p#x"]) and got[2] == "div > div > div"


def test_nodes_equal_the_parse(parsed):
    nodes, walks = parsed
    columns = [c.split()[0] for c in dom.SCHEMA.split(", ")]
    got = {(r["page_id"], r["pre"]): tuple(r[c] for c in columns) for r in nodes.collect()}
    assert got == {(k, n["pre"]): tuple(n[c] for c in columns) for k, page in walks.items() for n in page}


def test_metadata_and_sections_equal_a_walk(parsed):
    nodes, walks = parsed
    meta = {r["page_id"]: r for r in regions.metadata(nodes).collect()}
    held = {}
    for r in regions.section(nodes, F.lit(True)).collect():
        held.setdefault(r["page_id"], set()).add(r["pre"])
    for k, page in walks.items():
        first = lambda tag: next((n for n in page if n["tag"] == tag and _line(page, n)), None)  # noqa: B023, E731
        title = _line(page, first("h1")) if first("h1") else re.sub("^Program:\\s*", "", re.split("[|–]", _line(page, first("title")))[0]).strip() if first("title") else None
        assert meta[k]["title"] == title
        heads = [n for n in page if n["tag"] in regions.HEADINGS and _line(page, n)]
        if heads:
            level = int(heads[0]["tag"][1])
            stop = next((n["pre"] for n in heads[1:] if int(n["tag"][1]) <= level), len(page))
            assert held.get(k, set()) == {n["pre"] for n in page if heads[0]["post"] < n["pre"] < stop}
