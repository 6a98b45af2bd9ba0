"""Queries whose work once grew faster than their input, or did not spread."""

import re

from pyspark.sql import functions as F

from recordloom.dom import discovery, noise, regions, render
from recordloom.dom import nodes as dom
from recordloom.operators import plan_check, report
from recordloom.plans import limits, pages, records

SF = "/root/testdata/sf0.001"


def test_pages_of_customers_are_parsed_by_several_tasks(spark):
    """A task writes a file; the small rows that pages are made of fit one partition."""
    assert len(pages._accounts(spark, SF).inputFiles()) > 4


def test_plans_are_judged_once_and_not_shuffled_with_their_entries(spark):
    """What follows the judgement reads its narrow rows; the texts of entries are not among them."""
    for result in records.checked(spark, SF):
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        assert "link_code" not in plan and "requisite" not in plan


def test_courses_are_read_once_for_their_frequency(spark):
    """The terms in all are counted from what is counted for each course."""
    plan = records.feed_frequency(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan


def test_reports_keep_their_rows(spark):
    """a record is made of its report alone: no join of fields and rows, and reports that share a key keep their own rows."""
    row = "20231 BUAD 304 4.0 A Organizational Behavior"
    made = report.parse(spark.createDataFrame([(1, row), (1, f"{row}\n20231 MATH 125 4.0 B Calculus"), (2, "none")], "id int, text string"), "id")
    assert sorted(-1 if r["completed_courses"] is None else len(r["completed_courses"]) for r in made.collect()) == [-1, 1, 2]
    plan = records.report_records(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_responses_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    """more lines are more tasks, not larger ones."""
    monkeypatch.setattr(records, "LINES", 500, raising=False)
    assert records._responses(spark, SF).select(F.spark_partition_id()).distinct().count() > 10


def test_bodies_are_parsed_once_for_courses(spark):
    """nothing looks into a body before its courses are read, and what came first is known by then."""
    plan = records.feed_courses(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_assignments_limit_groups_before_the_shuffle(spark):
    """of a kind, as many courses as all needs are numbered, without settling or dealing them."""
    plan = limits.plan_assignments(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "range_of_rows" not in plan


def test_noise_is_marked_without_a_join(spark):
    """nodes are shuffled by page alone, not by their number first."""
    nodes = dom.nodes(spark.createDataFrame([(1, "<nav><p>a</p></nav><p>b</p>")], "page_id long, html string"))
    kept = noise.outside(nodes, nodes.where("tag = 'nav'"))
    assert [r["text"] for r in kept.where("tag = '#text'").collect()] == ["b"] and kept.columns == nodes.columns
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().toString()


def test_discovery_writes_what_it_reads(spark, monkeypatch):
    """columns that no link is found by are not written again and again."""
    written, keep = [], discovery.settled
    monkeypatch.setattr(discovery, "settled", lambda df: written.extend(df.columns) or keep(df))
    nodes = dom.nodes(spark.createDataFrame([(1, "<main><h2>A</h2><a href='x'>b</a><h2>C</h2></main>")], "page_id long, html string"))
    discovery.discover(nodes, spark.createDataFrame([(1, "https://a.example.org/")], "page_id long, url string"), F.lit(True), path="", ids=())
    assert written and "raw" not in written


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_metadata_is_joined_without_broadcasts(spark):
    """nodes are packed to a few bytes in files, so tables that grow would be broadcast through the driver."""
    plan = _plan(pages.account_metadata(spark, SF))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_sums_of_some_nodes_are_those_of_all(spark):
    """sums of chosen nodes need no join, and are the same."""
    html = "<div id='a'>x<p>yy<b>z</b></p><i></i></div><p id='c'>w</p>"
    nodes = dom.nodes(spark.createDataFrame([(1, html), (2, f"<div>{html}</div>")], "page_id long, html string"))
    measures = {"n": F.length("text"), "k": (F.col("tag") == "#text").cast("long")}
    rows = lambda df: sorted((r["page_id"], r["pre"], r["n"], r["k"]) for r in df.collect())
    some = regions.sums(nodes, measures, F.col("tag").isin("div", "i", "p"))
    assert rows(some) == rows(regions.sums(nodes, measures).where("tag in ('div', 'i', 'p')")) and len(rows(some)) == 9
    assert "Join" not in _plan(some)


def test_texts_are_joined_without_broadcasts(spark, monkeypatch):
    """no step of a rendering sends a table that grows through the driver."""
    plans, keep = [], render.settled
    for module in (render, noise, pages):
        monkeypatch.setattr(module, "settled", lambda df: plans.append(_plan(df)) or keep(df))
    plans.append(_plan(pages.account_text(spark, SF)))
    assert len(plans) > 5 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_noise_looks_at_each_node_by_itself(spark, monkeypatch):
    """what selectors fit is found without exploding, joining or shuffling nodes, and only the columns that it needs are parsed."""
    plans, keep = [], noise.settled
    monkeypatch.setattr(noise, "settled", lambda df: plans.append(_plan(df)) or keep(df))
    found = pages.account_noise(spark, SF)
    assert found.count() == 300
    head = plans[0][: plans[0].index("MapInArrow")]
    assert not any(word in head for word in ("Join", "Exchange", "Generate", "Window")) and "MapInArrow" not in _plan(found) and "href" in head and "within" not in plans[0]


def test_plain_pages_are_cut_as_others_are_parsed():
    """a page without references or comments gives the same nodes as one that needs the parser for what stands at its end."""
    page = '<div id=a class="x y"><p>1 > 2<b> b</b>  <p>q<br><table><tr><td colspan=2>c<td rowspan="3" id=\'s\'>d</table></DIV></p><li>e<li CLASS="">f</ul> g'
    plain = page.replace("'s'", "s")
    assert dom.PLAIN.fullmatch(plain) and not dom.PLAIN.fullmatch(page) and not dom.PLAIN.fullmatch(plain + "<!-- -->") and not dom.PLAIN.fullmatch("<title>a<b></title>")
    assert dom.parse(plain) == dom.parse(page) == dom.parse(plain + "<!-- -->") and len(dom.parse(plain)) == 19


def test_plans_of_any_size_are_judged_alike(spark, monkeypatch):
    """a plan's courses are compared in one list up to a size, in cells of time beyond; nothing but what is returned is shuffled after the judgement."""
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    courses, plans = records.checked(spark, SF)
    assert not re.search(r"(?<!n_)reasons|units", _plan(records.plan_validate(spark, SF)))
    assert any("conflicts with" in r for c in courses.collect() for r in c["reasons"])
    monkeypatch.setattr(plan_check, "AT_ONCE", 0)
    of_large = records.checked(spark, SF)
    assert rows(courses) == rows(of_large[0]) and rows(plans) == rows(of_large[1])
    monkeypatch.setattr(plan_check, "AT_ONCE", 3)
    mixed = records.checked(spark, SF)
    assert rows(courses) == rows(mixed[0]) and rows(plans) == rows(mixed[1])


def test_texts_read_nodes_once_where_pages_are_known(spark):
    """neither the pages nor what is shown as written is looked for among all nodes again, and nothing is lost."""
    made = [(1, "<p>a</p><pre>\n x\n  y\n</pre>"), (2, "<script>s</script>"), (3, "<ul><li>b</ul>")]
    nodes = dom.nodes(spark.createDataFrame(made, "page_id int, html string"))
    keys = spark.createDataFrame([(1,), (2,), (3,)], "page_id int")
    want = [(1, "a\n\n x\n  y\n"), (2, "\n"), (3, "- b\n")]
    assert sorted(map(tuple, render.rendered(nodes).collect())) == want and sorted(map(tuple, render.rendered(nodes, pages=keys).collect())) == want
    assert "MapInArrow" not in _plan(render.rendered(nodes.where("page_id > 1"), pages=keys))
