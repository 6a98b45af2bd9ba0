"""Ordered work by ranges, assignments, limits and containment against brute force."""

import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from recordloom.operators import containment, limits, ranges
from recordloom.operators import relational as rel


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def hot_rows(seed, n=300):
    r = random.Random(seed)
    return [(r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([None, *range(0, 60)]), k, r.choice([None, 1, 2, 5])) for k in range(n)]


@pytest.mark.parametrize("size", [20, 1_000_000])
def test_running_total_over_ranges(spark, size):
    rows = hot_rows(1)
    got = ranges.running_total(spark.createDataFrame(rows, "k string, t int, i int, v int"), ["k"], ["t", "i"], "v", "upto", size)
    want, total = [], {}
    for k, t, i, v in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        total[k] = total.get(k, 0) + (v or 0)
        want.append((k, t, i, v, total[k]))
    assert rows_of(got) == sorted(want, key=str)


@pytest.mark.parametrize("size", [20, 1_000_000])
def test_runs_over_ranges(spark, size):
    rows = [(k, t or 0, i, v) for k, t, i, v in hot_rows(8)]
    got = {r["k"]: (r["n_runs"], r["longest"]) for r in rel.runs(spark.createDataFrame(rows, "k string, t int, i int, v int"), ["k"], ["t", "i"], "v", size).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        values = [r[3] for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3])]
        sizes = [len(list(g)) for _, g in itertools.groupby(values)]
        want[k] = (len(sizes), max(sizes))
    assert got == want


@pytest.mark.parametrize("size", [20, 1_000_000])
@pytest.mark.parametrize("strict", [True, False])
def test_as_of_over_ranges(spark, size, strict):
    left, right = hot_rows(2), hot_rows(3, 120)
    schema = "k string, t int, i int, v int"
    got = ranges.as_of(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "k", "t", "i", ["i", "v"], strict, size)
    want = []
    for k, t, i, v in left:
        before = [(rt, ri, rv) for rk, rt, ri, rv in right if k is not None and t is not None and rk == k and rt is not None and (rt < t or (rt == t and not strict))]
        best = max(before, key=lambda x: x[:2], default=(None, None, None))
        want.append((k, t, i, v, best[1], best[2]))
    assert rows_of(got) == sorted(want, key=str)


@pytest.mark.parametrize("size", [9, 1_000_000])
def test_quantiles_over_ranges(spark, size):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), r.choice([None, 1.0, 2.0, r.random() * 50])) for _ in range(250)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    got = {x["k"]: (x["n"], x["median"], x["q1"], x["q3"]) for x in ranges.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", size).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, v in groups.items():
        q1, q3 = (min(v), max(v)) if len(v) < 4 else statistics.quantiles(v, n=4, method="exclusive")[::2]
        assert got[k] == pytest.approx((len(v), statistics.median(v), q1, q3))


def most_in_order(courses, needs):
    """The best numbers by requirement in their order, by trying every way to use every course."""
    best = (0,) * len(needs)
    for way in itertools.product(*[[None, *[r for r in range(len(needs)) if c >> r & 1]] for c in courses]):
        n = tuple(way.count(r) for r in range(len(needs)))
        if all(a <= b for a, b in zip(n, needs, strict=True)):
            best = max(best, n)
    return best


def test_flows_are_the_best_in_order():
    r = random.Random(5)
    for _ in range(60):
        needs = [r.randrange(4) for _ in range(3)]
        courses = [r.randrange(8) for _ in range(r.randrange(8))]
        kinds = {k: courses.count(k) for k in set(courses) if k}
        made = limits.flows(kinds, needs)
        assert all(n > 0 and kind >> q & 1 for (kind, q), n in made.items())
        assert all(sum(n for (k, _), n in made.items() if k == kind) <= c for kind, c in kinds.items())
        assert tuple(sum(n for (_, q), n in made.items() if q == k) for k in range(3)) == most_in_order(courses, needs)


def test_no_course_counts_twice(spark):
    r = random.Random(6)
    rows = [(r.choice(["s", "s", "t", "u", None]), k, r.random() < 0.5, r.random() < 0.4, r.choice([True, None])) for k in range(24)]
    df = spark.createDataFrame(rows, "student string, course int, a boolean, b boolean, c boolean")
    fits, needs = [F.col(c) for c in "abc"], [2, 3, 2]
    got = limits.assignments(df, "student", ["course"], fits, needs, size=5).collect()
    assert len({x["course"] for x in got}) == len(got)
    by = {x[1]: x for x in rows}
    assert all(by[x["course"]][1 + x["requirement"]] is True and by[x["course"]][0] == x["student"] for x in got)
    filled = {(x["student"], x["requirement"]): x["filled"] for x in limits.fills(df, "student", fits, needs).collect()}
    for s in ("s", "t", "u"):
        mine = [sum(bool(x[2 + q]) << q for q in range(3)) for x in rows if x[0] == s][:9]
        if len([x for x in rows if x[0] == s]) <= 9:
            assert tuple(filled[s, q] for q in (1, 2, 3)) == most_in_order(mine, needs)
        assert all(sum(x["student"] == s and x["requirement"] == q for x in got) == filled[s, q] for q in (1, 2, 3))
    assert limits.fills(df.limit(0), "student", fits, needs).count() == 0


def test_a_student_with_very_many_courses_is_a_small_graph():
    made = limits.flows({1: 10**9, 3: 10**9, 2: 5}, [10**9 + 7, 10**9])
    assert sum(made.values()) == 2 * 10**9 + 5 and sum(n for (_, r), n in made.items() if r == 0) == 10**9 + 7


def test_limits_in_the_order_of_courses(spark):
    rows = [("s", 1, 2.0, "pe"), ("s", 2, 3.0, "pe"), ("s", 3, 1.0, "pe"), ("s", 4, 9.0, "x"), ("t", 1, 4.0, "pe"), ("s", 5, None, "pe"), ("s", 6, 0.0, "pe"), (None, 6, 9.0, "pe")]
    got = limits.over_limits(spark.createDataFrame(rows, "student string, n int, units double, kind string"), "student", ["n"], "units", {"pe": (F.col("kind") == "pe", 4), "all": (F.lit(True), 14)}, size=2)
    assert rows_of(got) == [("s", "all", 4, 9.0, 15.0, 1.0), ("s", "pe", 2, 3.0, 5.0, 1.0), ("s", "pe", 3, 1.0, 6.0, 1.0)]


TEXTS = ["the cat sat on the mat", "a cat  sat", "\tcat", "xcat saty", "", None, "cat\nsat on\tthe mat", "ab", "a", "aé b", "one two one two one", "the the the the"]
STRINGS = ["cat sat", "at sat on t", "cat", "t", "", None, "a", "ab", "é b", " sat ", "cat  sat", "the mat", "the the the", "two one two", "sat on\tthe", "not there at all", "o one two one", "\n", "the cat sat on the mat"]


@pytest.mark.parametrize("most", [0, 1 << 18])
def test_containment_equals_a_search(spark, monkeypatch, most):
    monkeypatch.setattr(containment, "MAX_BROADCAST", most)
    r = random.Random(7)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randrange(1, 4)))
    texts = TEXTS + [" ".join(word() for _ in range(r.randrange(12))) for _ in range(40)]
    strings = STRINGS + [t[a : a + r.randrange(1, 18)] for t in texts if t for a in [r.randrange(len(t))]][:40]
    a = spark.createDataFrame(list(enumerate(texts)) + [(3, "cat again"), (None, "cat")], "t_id int, text string")
    b = spark.createDataFrame(list(enumerate(strings)) + [(None, "cat")], "s_id int, text string")
    want = {(i, j) for i, t in [*enumerate(texts), (3, "cat again")] for j, s in enumerate(strings) if t is not None and s and s in t}
    got = containment.contained_strings(a, "t_id", "text", b, "s_id", "text").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert containment.contained_strings(a, "t_id", "text", b.limit(0), "s_id", "text").collect() == []
