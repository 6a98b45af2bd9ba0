"""Operators on small tables with known results."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.dom import nodes as dom
from recordloom.functions import unicode as uni
from recordloom.dom import noise, regions, render
from recordloom.operators import audit, clauses, feed, gate, pages, plan_check, report, resolve, titles
from recordloom.operators import relational as rel
from recordloom.sources import files


def verdict(spark, body, name=""):
    row = gate.verdicts(spark.createDataFrame([(1, body, name)], "doc_id int, text string, name string"), name=F.col("name")).first()
    return row["verdict"], row["reasons"]


GOOD = "# Biology (BS)\n" + "\n".join(f"- BISC {100 + k} Topic number {k} Units: 4" for k in range(20))


def test_gate_reasons(spark):
    assert verdict(spark, GOOD, "Biology (BS)*") == ("PASS", [])
    assert verdict(spark, "")[1] == ["empty"]
    assert verdict(spark, None)[1] == ["empty"]
    assert verdict(spark, GOOD.replace("# Biology", "# Chart"), "Art (BA)")[1][0] == "no_title_heading"
    assert verdict(spark, "Skip to Navigation\n" + GOOD, "Biology")[0] == "FAIL"
    assert any(r.startswith("units_missing:20_of_20") for r in verdict(spark, GOOD.replace(" Units: 4", ""), "Biology")[1])
    long = "This sentence is long enough to count as a substantial one, being over eighty characters in all."
    assert "repeated_sentence_x3" in verdict(spark, GOOD + "\n" + " ".join([long] * 4), "Biology")[1]


def test_unit_loss_boundary(spark):
    def bullets(with_units, without):
        return "# T\n" + "\n".join([f"- AB {100 + k} x (4 units)" for k in range(with_units)] + [f"- CD {100 + k} x" for k in range(without)]) + "\nTotal units 9" + " pad" * 60

    lost = lambda b: any(r.startswith("units_missing") for r in verdict(spark, b, "T")[1])
    assert [lost(bullets(*x)) for x in ((0, 2), (0, 3), (2, 3), (2, 4), (4, 0))] == [False, True, False, True, False]


TITLES = [
    (1, "Biology (BS)", "", "Biology (BS)"), (2, "History, BA", "", None), (3, "Design (Track A) (BFA)*", "", "Design (MFA)"), (4, "Asia Minor Studies (BA)", "", "Asia Minor Studies (BA)"),
    (5, "Dance Minor", "", "Dance Minor"), (6, "Minor in Painting", "", "Painting (BA)"), (7, "Physics (PhD)", "", "Physics (PhD)"), (8, "Law (JD)", "", None), (9, "Economics (MA)", "", "Economics (BA)"),
    (10, "Chemistry (BS) / Chemistry (MS)", "", "Chemistry (BS)"), (11, "Graduate Certificate in Ethics", "", None), (12, "Certificate in Data", "", None), (13, "Joint Degree BA/JD", "", None), (14, "Dual Degree in Music", "", None),
    (15, "Progressive Degree in Film (MA)", "", None), (16, "Pre-Professional Emphasis", "", None), (17, "Bachelor of Arts in Letters", "", None), (18, "Doctor of Music", "", None), (19, "Undecided", "", "Undecided (BA)"),
    (20, "Music&nbsp;Industry (BM)†", "", "Music Industry (BM)"), (21, "Combined Degree in Art", "", None), (22, "Public Policy", "Minor", None), (23, "Systems (BS and MS)", "", None), (24, "Basics of Art", "", None), (25, "", "", None),
]


def test_titles_and_modes(spark):
    rows = titles.classify(spark.createDataFrame(TITLES, "id int, title string, label string, page string"))
    got = {r["id"]: r["class"] for r in rows.collect()}
    want = {1: "included", 2: "included", 4: "included", 5: "excluded_minor", 7: "excluded_doctoral", 8: "excluded_professional", 9: "excluded_masters", 10: "excluded_combined", 11: "excluded_graduate_certificate", 13: "excluded_joint", 15: "excluded_progressive", 17: "included", 18: "excluded_doctoral", 19: "manual_review", 24: "manual_review"}
    assert {k: got[k] for k in want} == want


def test_reconcile(spark):
    rows = spark.createDataFrame([("included", "included"), ("included", "excluded_minor"), ("manual_review", "included"), ("excluded_minor", "included"), ("included", None)], "a string, b string")
    assert [r[0] for r in rows.select(titles.reconciled(F.col("a"), F.col("b"))).collect()] == ["included", "excluded_minor", "included", "manual_review", "included"]


def test_challenge(spark):
    cases = ["<title>Just a moment...</title>", "<p>captcha</p>", "<p>captcha</p>" + "<p>" + "word " * 900 + "</p>", "<noscript>access denied</noscript><p>ok</p>", "<script src='hcaptcha.com'></script>" + "x " * 4000, None]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "i int, h string").orderBy("i")
    assert [r[0] for r in pages.challenged(rows, "h").orderBy("i").select("challenge.challenged").collect()] == [True, True, False, False, True, False]


PLANS = [("p1", 1, "CSCI 104", ["1", "2"]), ("p1", 2, "MATH 225", ["3"]), ("p1", 3, "HIST 400", ["9"]), ("p2", 1, "csci 104", ["1"]), ("p2", 2, "ART 101", ["5"]), ("p3", 1, "ART 101", ["6"])]
STUDENTS = [("p1", "Computer Science", "Sophomore", 3.5, ["MATH 126"], ["MATH 225"]), ("p2", "History", "Senior", None, ["CSCI 103"], []), ("p3", "Art", None, 3.0, [], [])]
_S = lambda kind, i, link=None, notes=None, full=False, days=("M",), a="10:00", b="11:00": (kind, i, link, notes, False, full, list(days), a, b)
CATALOG = [
    ("CSCI 104", "Prerequisite: CSCI 103; requires a 2.0 GPA", 4.0, True, False, False, False, [_S("lectures", "1", "A"), _S("labs", "2", "A", days=("T",))]),
    ("MATH 225", None, 4.0, False, False, True, False, [_S("lectures", "3", a="10:30", b="12:00")]),
    ("ART 101", "Prerequisite: consent", 2.0, False, False, False, True, [_S("lectures", "5", notes="Reserved for students in the School of Art. B.A. only", full=True, days=()), _S("lectures", "6", notes="Only open to undergraduate students", a="TBA")]),
]
CLEARANCE = [(1, "exact", "MATH", "all MATH courses", "write to the office")]


def checked(spark):
    section = "array<struct<kind string, section_id string, link_code string, notes string, is_cancelled boolean, is_full boolean, days array<string>, start_time string, end_time string>>"
    return plan_check.validate(
        spark.createDataFrame(PLANS, "plan_id string, ord long, course string, sections array<string>"),
        spark.createDataFrame(STUDENTS, "plan_id string, major string, class_level string, gpa double, completed array<string>, in_progress array<string>"),
        spark.createDataFrame(CATALOG, f"code string, description string, units double, has_lab boolean, has_discussion boolean, has_clearance boolean, has_restrictions boolean, sections {section}"),
        spark.createDataFrame(CLEARANCE, "ord int, kind string, prefix string, required_for string, how_to string"),
    )


def test_plan_reasons(spark):
    courses, overall = checked(spark)
    got = {(r["plan_id"], r["ord"]): r["reasons"] for r in courses.collect()}
    assert "CSCI 104 lacks prerequisites: CSCI 103" in got["p1", 1] and "CSCI 104 conflicts with MATH 225" in got["p1", 1]
    assert "MATH 225 is in progress" in got["p1", 2] and "clearance: write to the office" in got["p1", 2]
    assert got["p1", 3] == ["Sophomores may not be eligible for HIST 400", "HIST 400 is not in the catalog"]
    assert "csci 104 needs a lab section and none is chosen" in got["p2", 1]
    assert "ART 101 is reserved for: School of Art" in got["p2", 2]
    assert {r["plan_id"]: (r["overall"], r["total_units"], len(r["warnings"])) for r in overall.collect()} == {"p1": ("invalid", 8.0, 1), "p2": ("invalid", 6.0, 0), "p3": ("invalid", 2.0, 0)}
    assert {(k, len(v)) for k, v in got.items()} == {(("p1", 1), 2), (("p1", 2), 5), (("p1", 3), 2), (("p2", 1), 2), (("p2", 2), 4), (("p3", 1), 3)}


def test_caps_and_grades(spark):
    rows = spark.createDataFrame([("p", "music", 10.0), ("p", "music", 8.0), ("p", "other", 50.0)], "plan_id string, kind string, units double")
    got = {r["kind"]: (r["counted"], r["over"]) for r in plan_check.unit_caps(rows, {"music": 16, "pe": 4}).collect()}
    assert got == {"music": (16.0, True), "other": (50.0, False)}
    grades = spark.createDataFrame([("A",), ("D",), ("NC",)], "g string")
    assert [r[0] for r in grades.select(plan_check.grade_rule(F.col("g"))).collect()] == ["ok", "caution", "fail"]


def test_conflicts_equal_all_pairs(spark):
    r = random.Random(3)
    slots = [(p, i, (s := r.randint(0, 300)), s + r.randint(0, 120)) for p in range(5) for i in range(20)]
    got = {(x["g"], x["a"], x["b"]) for x in rel.interval_conflicts(spark.createDataFrame(slots, "g int, i int, s int, e int"), ["g"], "i", "s", "e").collect()}
    want = {(a[0], a[1], b[1]) for a in slots for b in slots if a[0] == b[0] and a[1] < b[1] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3]}
    assert got == want


def test_prefix_precedence(spark):
    rows = spark.createDataFrame([(1, "alias", "A", "a1"), (2, "exact", "A", "e2"), (3, "alias", "A", "a3"), (4, "exact", "A", "e4"), (5, "fallback", "B", "f5"), (6, "alias", "B", "a6")], "ord int, kind string, prefix string, entry string")
    assert {r["prefix"]: r["entry"] for r in rel.prefix_index(rows).collect()} == {"A": "e4", "B": "f5"}


def test_upsert_keeps_the_sequence(spark):
    old = spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "k int, seq int, v string")
    new = spark.createDataFrame([(2, 99, "B"), (3, 30, "c")], "k int, seq int, v string")
    once = rel.upsert(old, new, ["k"], ["seq"])
    assert sorted(map(tuple, once.collect())) == [(1, 10, "a"), (2, 20, "B"), (3, 30, "c")]
    assert sorted(map(tuple, rel.upsert(once, new, ["k"], ["seq"]).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, rel.insert_absent(old, new, ["k"]).collect())) == [(1, 10, "a"), (2, 20, "b"), (3, 30, "c")]


def test_sequence_continues(spark):
    known = spark.createDataFrame([(5, 1), (9, 2)], "k long, seq long")
    new = spark.createDataFrame([(9,), (2,), (20000,)], "k long")
    assert sorted(map(tuple, rel.continued(known, new, "k", "seq").collect())) == [(2, 3), (5, 1), (9, 2), (20000, 4)]


def test_compare_runs(spark):
    b = spark.createDataFrame([(1, "FAIL", "x"), (2, "PASS", "x"), (3, "PASS", "x"), (4, "PASS", "x")], "k int, s string, m string")
    a = spark.createDataFrame([(1, "PASS", "y"), (2, "FAIL", "x"), (3, "PASS", "z"), (5, "PASS", "q")], "k int, s string, m string")
    assert {r["k"]: r["change"] for r in audit.compare_runs(b, a, "k", "s", "m").collect()} == {1: "repaired", 2: "regressed", 3: "changed", 4: "removed", 5: "added"}


HTML = """<html><body><nav><a href='/x'>Skip</a></nav><main><h1>Title</h1><p>One <b>two</b> three<ul><li>a<li>b<ol start=3><li>c<li value=7>d<li>e</ol></ul>
<table><tr><th>k<th>v<tr><td>1<td>2</table><dl><dt>t<dd>d</dl><h2>Next</h2><p><a href='/y'>why</a> <a href='/y'>again</a></main></body></html>"""


def test_render_and_links(spark):
    n = dom.nodes(spark.createDataFrame([(1, HTML), (2, None), (3, "")], "page_id int, html string"))
    text = {r["page_id"]: r["text"] for r in render.rendered(noise.cleaned(n)).collect()}
    assert text[1] == "# Title\n\nOne two three\n\n- a\n- b\n  3. c\n  7. d\n  8. e\n\nTABLE:\nColumns: k | v\nRow 1: 1 | 2\n\nt:\n  d\n\n## Next\n\nwhy again\n"
    assert [(r["seq"], r["href"], r["title"]) for r in regions.links(n).orderBy("seq").collect()] == [(1, "/x", "Skip"), (2, "/y", "why")]
    chosen = regions.region(n).first()
    assert chosen["o_tag"] == "main"
    cut = regions.section(n, F.col("heading") == "Title").where("tag = '#text'").count()
    assert cut == n.where("tag = '#text' and page_id = 1").count() - 2


GRID = """<body><table><caption>Cap</caption><tr><th>A</th><th>B</th><th>C</th></tr><tr><td rowspan=2>x</td><td colspan=2>y<ul><li>z</ul></td></tr><tr><td></td><td>w</td></tr><tr><td></td></tr></table>
<table role=presentation><tr><td>one</td><td>two</td></tr></table><p>see <a href='https://x.example.com/p'>here</a><sup>1</sup> <a href='https://y.example.com/'>y.example.com</a></p><hr><p>Back to top</p><p>help | back to top</p></body>"""


def test_render_tables_links_and_interface(spark):
    n = dom.nodes(spark.createDataFrame([(1, GRID)], "page_id int, html string"))
    assert render.rendered(n, ["back to top", "help"]).first()["text"].split("\n") == [
        "TABLE: Cap", "Columns: A | B | C", "Row 1: x | y z | y z", "Row 2: x |  | w", "", "one", "", "two", "", "see here [https://x.example.com/p][1] y.example.com", "", "---",
    ] + [""]


def test_node_intervals(spark):
    rows = {r["pre"]: r for r in dom.nodes(spark.createDataFrame([(1, HTML)], "page_id int, html string")).collect()}
    for r in rows.values():
        if r["parent"] >= 0:
            p = rows[r["parent"]]
            assert p["pre"] < r["pre"] <= r["post"] <= p["post"] and r["depth"] == p["depth"] + 1


def test_report_helpers(spark):
    frag = spark.createDataFrame([(1, 5.0, 10, "b"), (1, 1.0, 10, "a"), (1, 2.0, 9, "c")], "page int, x double, y int, s string")
    assert {r["y"]: r["line"] for r in report.rebuilt_lines(frag).collect()} == {10: "a b", 9: "c"}
    rows = spark.createDataFrame([("x" * 101, "o"), ("short", "o"), (None, "o")], "t string, o string")
    assert [r[0][0] for r in rows.select(report.text_or_ocr(F.col("t"), F.col("o"))).collect()] == ["x", "o", "o"]
    lines = spark.createDataFrame([(1, 1, "a"), (1, 2, "-----"), (1, 3, "b")], "k int, p int, l string")
    assert [r["chunk"] for r in report.chunks(lines, "k", "p", "l").orderBy("p").collect()] == [0, 1, 1]


def test_clause_rules_are_unique():
    rows = clauses.rule_rows()
    assert len(rows) == len(set(rows)) and len({r[0] for r in rows}) == 16


def test_locators(spark):
    page = "<html><head><title>Art | Site</title></head><body id=b><p>School of Fine Arts</p><div class='x y'><h2>Z</h2></div></body></html>"
    n = dom.nodes(spark.createDataFrame([(1, page), (2, HTML), (3, None)], "page_id int, html string"))
    assert "html > body#b > div.x > h2" in {r["path"] for r in regions.locators(n).collect()}


def test_entries_need_sections(spark):
    plan = spark.createDataFrame([("p", 1, "A 1", [])], "plan_id string, ord long, course string, sections array<string>")
    with pytest.raises(Exception, match="needs its sections"):
        plan_check.require_sections(plan).collect()


def test_members_of_a_large_group_are_listed(spark):
    rows = [(i, "one body") for i in range(1500)] + [(2000, "pair"), (2001, "pair"), (3000, "single")]
    got = {(r["member"], r["n"]) for r in audit.members(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert got == {(i, 1500) for i in range(1500)} | {(2000, 2), (2001, 2)}


def test_page_keys_of_any_kind(spark):
    pages = spark.createDataFrame([("a", "<p>x</p>"), (None, "<p>y</p>"), ("c", None)], "page_id string, html string")
    assert {(r["page_id"], r["text"]) for r in dom.nodes(pages).where("tag = '#text'").collect()} == {("a", "x"), (None, "y")}


def test_text_in_unicode_forms(spark):
    texts = ["Ｆｕｌｌ ﬁt\u200b", "Ärger élan", "STRASSE straße", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(uni.nfkc("t").alias("a"), uni.nfkd_ascii("t").alias("b"), uni.casefold("t").alias("c")).collect()
    assert [r["a"] for r in rows] == ["Full fit\u200b", "Ärger élan", "STRASSE straße", None, ""]
    assert [r["b"] for r in rows][:2] == ["Full fit", "Arger elan"] and [r["c"] for r in rows][2:] == ["strasse strasse", None, ""]
    assert [r[0] for r in spark.createDataFrame([("Café (B.A.)",), ("con",)], "t string").select(uni.name_slug("t")).collect()] == ["cafe_b_a", "con"]


def test_relative_urls(spark):
    base = "http://a.org/b/c/d?q"
    hrefs = ["g", "../g", "/g", "//h/g", "?x", "", "#s", "https://z/y", None, "./../../../g", "[bad"]
    got = [r[0] for r in spark.createDataFrame([(base, h) for h in hrefs], "b string, h string").select(uni.resolve("b", "h")).collect()]
    assert got == ["http://a.org/b/c/g", "http://a.org/b/g", "http://a.org/g", "http://h/g", "http://a.org/b/c/d?x", base, base + "#s", "https://z/y", None, "http://a.org/g", "http://a.org/b/c/[bad"]


def test_conditional_changes_leave_unknown_rows(spark):
    rows = spark.createDataFrame([(1, "running"), (2, None), (3, "done")], "k int, status string")
    running = F.col("status") == "running"
    assert {r.k: r.status for r in rel.update_where(rows, running, status=F.lit("pending")).collect()} == {1: "pending", 2: None, 3: "done"}
    assert {r.k for r in rel.delete_where(rows, running).collect()} == {2, 3}


def test_checks_of_an_empty_and_a_faulty_table(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, v string")
    found = lambda df: {r.name: (r.n_failed, r.ok) for r in audit.checks(df, {"has_v": F.col("v").isNull()}, {"unique": ["k"]}).collect()}
    assert found(rows) == {"has_v": (1, False), "unique": (1, False), "all": (2, False)}
    assert found(rows.where("k > 5")) == {"has_v": (0, True), "unique": (0, True), "all": (0, True)}


def test_dump_writes_rows_and_totals(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    files.dump(rows, str(tmp_path), n_named=F.col("v").isNotNull())
    assert spark.read.text(str(tmp_path / "totals")).first()[0] == '{"n":2,"n_named":1}'
    assert spark.read.json(str(tmp_path / "rows")).count() == 2


PHRASES = [(1, "No more than two (2) outside courses"), (2, "at least four courses"), (3, "one or more electives"), (4, "A maximum of 8 units"), (5, "fewer than 3 courses"), (6, "choose ten units")]


def test_phrases(spark):
    rows = spark.createDataFrame(PHRASES, "id int, text string").select("id", clauses.normal_phrase(F.col("text")).alias("p")).collect()
    assert {r["id"]: r["p"] for r in rows} == {1: "max 2 outside courses", 2: "min 4 courses", 3: "min 1 electives", 4: "max 8 units", 5: "under 3 courses", 6: "choose 10 units"}


def test_segments_with_many_branches(spark):
    text = "Choose one; " + "; ".join(f"otherwise, take course {k}" for k in range(30)) + "."
    rows = clauses.segments(spark.createDataFrame([("Art Minor", text), ("B", None), ("C", "")], "program string, text string"), "program").where("program = 'Art Minor'").orderBy("requirement_id").collect()
    assert len(rows) == 31 and {r["requirement_id"] for r in rows} >= {"ART-MINOR-01a", "ART-MINOR-01d", "ART-MINOR-01z", "ART-MINOR-0127"}


SECTION = "{{\"sisSectionId\": \"{0}\", \"rnrMode\": \"{1}\", \"totalSeats\": 30, \"registeredSeats\": {2}, \"linkCode\": \"{3}\", \"hasDClearance\": {4}, \"notes\": {5}, \"instructors\": [{{\"firstName\": \"Ada\", \"lastName\": \"L\"}}], \"schedule\": [{{\"days\": [\"M\"], \"startTime\": \"10:00\", \"endTime\": \"11:00\"}}]}}"
FEEDS = [
    ("20263", "ART", 1, "{\"courses\": [{\"courseId\": \"c1\", \"fullCourseName\": \"ART 101\", \"courseUnits\": [4.0], \"sections\": [" + SECTION.format("1", "Lecture", 35, "A", "true", "null") + ", " + SECTION.format("2", "Lab", 10, "A", "false", "\"ask\"") + "]}, {\"courseId\": \"c2\", \"fullCourseName\": \"MUS 101\", \"courseUnits\": [2.0], \"sections\": []}]}"),
    ("20263", "MUS", 2, "{\"courses\": [{\"courseId\": \"c1\", \"fullCourseName\": \"MUS 999\"}, {\"courseId\": \"c2\", \"fullCourseName\": \"MUS 101\", \"courseUnits\": [2.0], \"sections\": []}]}"),
    ("20261", "ART", 1, "{\"courses\": [{\"courseId\": \"c1\", \"fullCourseName\": \"ART 101\", \"courseUnits\": [], \"sections\": []}]}"),
    ("20261", "BAD", 2, "not json"),
]


def test_feeds(spark):
    responses = spark.createDataFrame([*FEEDS, ("20262", "NON", 3, '{"courses": []}'), ("20262", "NUL", 4, None)], "term string, dept string, dept_ord int, body string")
    courses = feed.courses(responses)
    got = {(r["term"], r["course_id"]): (r["course_name"], r["units"], r["has_lab"], r["has_clearance"], r["has_restrictions"], r["section_counts"]) for r in courses.collect()}
    assert got == {("20263", "c1"): ("ART 101", 4.0, True, True, True, {"labs": 1, "lectures": 1}), ("20263", "c2"): ("MUS 101", 2.0, False, False, False, {}), ("20261", "c1"): ("ART 101", None, False, False, False, {})}
    first = courses.where("has_lab").first()["sections"]["lectures"][0]
    assert (first["instructor"], first["open_seats"], first["start_time"], first["days"]) == ("Ada L", 0, "10:00", ["M"])
    assert {r["dept"]: r["state"] for r in feed.departments(responses).collect() if r["term"] != "20263"} == {"ART": "ok", "BAD": "failed", "NON": "empty", "NUL": "failed"}


SITE = [
    (1, """<ul><li><a href="index.php?catoid=20">Catalogue 2024-2025</a> [ARCHIVED]</li><li><a href="index.php?catoid=22">Catalogue 2026–2027</a></li><li><a href="index.php?catoid=22">Catalogue again</a></li><li><a href="index.php?catoid=9">About</a></li></ul>
    <nav><a href="content.php?catoid=22&navoid=1">Programs and more</a><a href="content.php?catoid=22&navoid=2">Programs</a><a href="content.php?catoid=20&navoid=3">Programs</a></nav>
    <main><a href="preview_program.php?catoid=22&poid=5&returnto=1">Art (BA)</a><a href="/preview_program.php?catoid=22&poid=6#x">Law</a><a href="preview_program.php?poid=5&catoid=22">Art</a><a href="preview_program.php?catoid=22&poid=">None</a><a href="#top">Top</a></main>"""),
]


def test_sites(spark):
    links = resolve.anchors(dom.nodes(spark.createDataFrame(SITE, "page_id int, html string")))
    assert sorted((r["edition"], r["year"], r["archived"]) for r in resolve.editions(links).collect()) == [("20", "2024-2025", True), ("22", "2026-2027", False)]
    assert resolve.current(resolve.editions(links)).first()["edition"] == "22" and resolve.navigation(links, "Programs", F.lit("22")).first()["id"] == "2"
    kept, counts = resolve.program_links(links)
    assert [(r["seq"], r["poid"], r["title"]) for r in kept.orderBy("seq").collect()] == [(1, "5", "Art (BA)"), (2, "6", "Law")] and counts.first()["duplicates"] == 1
