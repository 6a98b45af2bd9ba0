"""Codes, times, modes and ids on rows that the tables don't have."""

from pyspark.sql import functions as F

from recordloom.functions import codes
from recordloom.operators import pages, resolve

CODES = {
    "csci 104": ("CSCI 104", "CSCI", 104), "CSCI104L extra": ("CSCI 104L", "CSCI", 104), "  math 225 ": ("MATH 225", "MATH", 225), "hello": ("HELLO", "HELLO", None), "BUAD-304": ("BUAD-304", "BUAD", 304),
    "ee 101lx": ("EE 101L", "EE", 101), "": ("", "", None), "20263": ("20263", "20263", 20263),
}
TIMES = {"09:30": 570, "25:99": 1599, "TBA": None, "": None, None: None, "9": None, "10:15:00": None, "ab:cd": None, "00:00": 0, "13:05": 785}


def test_codes(spark):
    c = F.col("c")
    rows = spark.createDataFrame([(k,) for k in CODES], "c string").select("c", codes.normal_code(c), codes.prefix(c), codes.number(c)).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == CODES


def test_terms(spark):
    c = F.col("c")
    rows = spark.createDataFrame([(k,) for k in ("20263", "20241", "2024x", "hello")], "c string").select("c", codes.academic_year(c), codes.season(c)).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == {"20263": ("2026-27", "fall"), "20241": ("2024-25", "spring"), "2024x": (None, None), "hello": (None, None)}


def test_times(spark):
    assert {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in TIMES], "c string").select("c", codes.minutes(F.col("c"))).collect()} == TIMES
    labels = spark.createDataFrame([(m,) for m in (0, 570, 725, 785, 1439)], "m int").select(codes.clock_label(F.col("m"))).collect()
    assert [r[0] for r in labels] == ["12:00 AM", "9:30 AM", "12:05 PM", "1:05 PM", "11:59 PM"]


def test_modes(spark):
    rows = [(1, None, False, True, 200), (2, "reset", False, False, None), (3, None, True, True, 200), (4, None, False, False, 200), (5, None, False, True, 503)]
    made = spark.createDataFrame(rows, "id int, e string, c boolean, v boolean, s int").select("id", pages.acquisition_mode(F.col("e"), F.col("c"), F.col("v"), F.col("s"))).collect()
    assert [r[1] for r in sorted(made)] == ["direct", "network_failure", "challenge", "invalid", "invalid"]


def test_final_ids(spark):
    rows = [(1, "http://x/p?catoid=1&poid=2", "https://x/p?poid=2&catoid=1&print"), (2, "http://x/p?catoid=1&poid=2", "http://x/p?catoid=1&poid=3"), (3, "http://x/p?catoid=1&poid=2", "http://x/p?catoid=1")]
    made = spark.createDataFrame(rows, "id int, a string, b string").select("id", resolve.same_page(F.col("a"), F.col("b"), ["catoid", "poid"])).collect()
    assert [r[1] for r in sorted(made)] == [True, False, False]
