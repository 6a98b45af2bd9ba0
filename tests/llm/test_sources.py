"""Mixing, URL filters, the text primitives and the pipeline."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import anchors, mixing, url_filter
from recordloom.llm import textkit as tk
from recordloom.llm.queries import OP2_SQL, OP4_SQL, queries
from tests.compare import TABLES, connect, duck_rows, spark_rows
from tests.llm.edge import EXTRA, edge_docs, edge_rows, empty_docs, words

SF = "/root/testdata/sf0.001"


def test_mix_query(spark):
    assert spark_rows(queries()["op2_mix"](spark, SF)) == duck_rows(connect(SF), OP2_SQL)


@pytest.mark.parametrize("block", [64, None])
def test_mix_is_even_and_near_its_targets(spark, block):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed, sized, per = mixing.mix(docs, block_words=block)
    rows = mixed.join(sized.select("row", "source"), "row").collect()
    targets = {r["source"]: r for r in per.collect()}
    n_slots, block = mixing.slot_count(per, block)
    slots: dict[int, dict] = {}
    for r in rows:
        s = slots.setdefault(r["slot"], {"source": r["source"], "n": 0})
        assert s["source"] == r["source"]
        s["n"] += r["n_words"]
    # the owner of every slot, by the rule itself
    total, edge, edges = sum(t["quota"] for t in targets.values()), 0, []
    for t in sorted(targets.values(), key=lambda t: t["sid"]):
        edges.append((edge / total * 2**32 // 1, (edge + t["quota"]) / total * 2**32 // 1, t["source"]))
        edge += t["quota"]
    left = {k: 2 * t["source_size"] for k, t in targets.items()}
    for slot in range(n_slots):
        owner = next(k for lo, hi, k in edges if lo <= slot * mixing.GOLDEN % 2**32 < hi)
        words = min(block, left[owner])
        left[owner] -= words
        assert slots.get(slot, {"n": 0})["n"] == words and (not words or slots[slot]["source"] == owner)
    taken: dict[str, int] = {}
    for s in slots.values():
        taken[s["source"]] = taken.get(s["source"], 0) + s["n"]
    assert all(abs(taken.get(k, 0) - t["target"]) <= 4 * block + 1 for k, t in targets.items())
    # any tenth of the schedule holds the sources by their shares
    for cut in range(0, n_slots - n_slots // 10, n_slots // 10):
        part = range(cut, cut + n_slots // 10)
        for k, t in targets.items():
            n = sum(slots[s]["source"] == k for s in part if s in slots)
            assert abs(n - t["quota"] / total * len(part)) <= 5


def test_mixed_texts(spark):
    docs = edge_docs(spark)
    got = mixing.mixed_texts(docs, block_words=50).collect()
    words = {str(r[0]) + str(r[3]): re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in edge_rows() if r[0] != 18}
    for r in got:
        if r["doc_id"] != 18:
            assert re.findall(r"[^\x20\x09-\x0D]+", r["text"]) == words[str(r["doc_id"]) + str(r["source"])][r["first_word"] : r["first_word"] + r["n_words"]]
    digest = mixing.mix_digest(docs, block_words=50).collect()
    assert sum(r["n_words"] for r in got) == sum(r["taken"] for r in digest) and len(got) == sum(r["n_parts"] for r in digest)
    assert mixing.mixed_texts(empty_docs(spark)).count() == 0


def test_mix_edges(spark):
    rows = mixing.mix_digest(edge_docs(spark)).collect()
    again = mixing.mix_digest(edge_docs(spark)).collect()
    assert len(rows) == len(edge_rows()) and sorted(map(str, rows)) == sorted(map(str, again))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows) and {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix_digest(empty_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix_digest(blank).collect()} == {(0, 0.0, 0)}


def test_targets_by_resharing(spark):
    r = random.Random(8)
    for _ in range(3):
        sizes = [(f"s{k:02d}", r.choice([0, 5, 50, 500, 5000])) for k in range(12)]
        weight = [5.0, 2.0, 1.0]
        total, cap = 1.5 * sum(n for _, n in sizes), {k: 2.0 * n for k, n in sizes}
        full: set[str] = set()
        while True:
            left, open_w = total - sum(cap[k] for k in full), sum(weight[i % 3] for i, (k, _) in enumerate(sizes) if k not in full)
            want = {k: cap[k] if k in full else left * weight[i % 3] / open_w for i, (k, _) in enumerate(sizes)}
            over = {k for k in want if want[k] > cap[k]}
            if not over:
                break
            full |= over
        per = mixing.targets(spark.createDataFrame(sizes, "source string, size long"), (5, 2, 1), 1.5, 2)
        got = {x["source"]: x["target"] for x in per.collect()}
        assert got == pytest.approx(want)


def test_url_query(spark):
    assert spark_rows(queries()["op4_url_filter"](spark, SF)) == duck_rows(connect(SF), OP4_SQL)


def test_url_edges(spark):
    listed = spark.createDataFrame([("bad.example.org",), ("bad.example.org",), (None,), ("never.seen.here",)], "key string")
    urls = [None, "", "no scheme", "http://BAD.example.org", "x://sub.bad.example.org/a?b#c", "https://good.example.org?x", "http://a.example.com/en/1", "http://WWW.example.com/en/", "http://a.net/fr/", "http://net/es/", "http://xnet/es/", "a://b://c/d", "http://İ.example.com/", "http://com"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:4])], "page_id long, url string").withColumns({c: F.lit(1) for c in [*EXTRA, "host", "rule", "listed", "domain"]})
    from recordloom.llm.queries import RULES

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(rows, RULES, listed).collect()}
    want = [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("bad.example.org", "", None, "block"), ("sub.bad.example.org", "/a", None, "block"), ("good.example.org", "", None, "allow"),
        ("a.example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("a.net", "/fr/", "net/fr/", "block"), ("net", "/es/", "net/es/", "block"), ("xnet", "/es/", None, "allow"),
        ("b:", "//c/d", None, "allow"), ("İ.example.com", "/", "com/", "allow"), ("com", "", None, "allow"),
    ]
    assert got == dict(enumerate(want + want[:4]))
    assert url_filter.url_verdicts(rows.limit(0), RULES, listed).count() == 0
    assert {r["verdict"] for r in url_filter.url_verdicts(rows.where("page_id in (3, 4)"), RULES, listed.limit(0)).collect()} == {"allow"}


def test_listed_keys_of_any_depth_are_found(spark):
    listed = spark.createDataFrame([("bad.org",), ("a.b.worse.org",), ("x.evil.org",), (None,)], "key string")
    hosts = ["bad.org", "www.bad.org", "p.q.r.bad.org", "notbad.org", "a.b.worse.org", "z.a.b.worse.org", "b.worse.org", "x.evil.org:8080", "y.x.evil.org.", "x.evil.org.:80", "evil.org", "org"]
    rows = spark.createDataFrame([(h, f"http://{h}/p") for h in hosts] + [("none", None)], "page_id string, url string")
    got = {r["page_id"]: (r["host"], r["verdict"]) for r in url_filter.url_verdicts(rows, [("allow", "com", "/")], listed).collect()}
    fine = {"notbad.org", "b.worse.org", "evil.org", "org"}
    assert got == {h: (h, "allow" if h in fine else "block") for h in hosts} | {"none": ("", "allow")}
    ruled = spark.createDataFrame([(1, "http://x.com:80/p")], "page_id long, url string")
    assert [r["rule"] for r in url_filter.url_verdicts(ruled, [("allow", "com", "/")], listed).collect()] == [None]


def test_ports_and_trailing_dots_equal_the_sql(spark, tmp_path):
    """Rules fit the host with its port and dot, listed names the host without them; the query and its SQL agree."""
    hosts = ["www.example.com:8080", "a.net.", "a.net.:80", "a.net", "spam-farm.example.com", "x.spam-farm.example.com:8080", "spam-farm.example.net.", "casino-win.example.org.:443", "notspam-farm.example.org", "example.com:", "b:c:80"]
    urls = [f"http://{h}{path}" for h in hosts for path in ("/en/a", "/es/x", "/fr/", "", "?q")] + [None, "", "x"]
    for t in TABLES:
        spark.createDataFrame([(k, u) for k, u in enumerate(urls)] if t == "pages" else [], "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    got = queries()["op4_url_filter"](spark, str(tmp_path))
    assert spark_rows(got) == duck_rows(connect(str(tmp_path)), OP4_SQL)
    rules = {(r["host"], r["path"]): (r["rule"], r["verdict"]) for r in got.collect()}
    assert rules["www.example.com:8080", "/en/a"] == (None, "allow") and rules["a.net.", "/es/x"] == (None, "allow") and rules["a.net", "/es/x"] == ("net/es/", "block")
    assert rules["x.spam-farm.example.com:8080", ""] == (None, "block")


@pytest.mark.parametrize("max_broadcast", [1 << 26, 3000])
def test_cascade_is_exact(spark, max_broadcast):
    rows = spark.range(20000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("host"))
    listed = spark.range(0, 20000, 7).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"))
    got = {r["host"] for r in url_filter.listed_flags(rows, "host", listed, max_broadcast=max_broadcast).where("listed").collect()}
    assert got == {f"h{i}" for i in range(0, 20000, 7)}


def test_words_and_hashes():
    texts = ["a  bb\tc", None, "", "\x85é x\x0by", "a bb", "\u00a0z"]
    data, at = tk.utf8(pa.array(texts))
    starts, ends, first = tk.words(data, at)
    got = [[data[s:e].tobytes().decode() for s, e in zip(starts[first[r] : first[r + 1]], ends[first[r] : first[r + 1]], strict=True)] for r in range(len(texts))]
    assert got == [["a", "bb", "c"], [], [], ["\x85é", "x", "y"], ["a", "bb"], ["\u00a0z"]]
    code = tk.word_codes(data, starts, ends)
    assert code[0] == code[first[4]] and len(set(code.tolist())) == len(code) - 2
    assert [c[:2] for c in tk.chunks(data, at, 4)][-1][1] == len(texts)
    sliced = pa.array(texts).slice(3, 2)
    d, a = tk.utf8(sliced)
    assert d[a[0] : a[1]].tobytes().decode() == texts[3]


def test_anchors_mark_equal_windows_alike():
    r = np.random.default_rng(5)
    common = r.integers(0, 4, 60)
    codes = tk.mix(np.concatenate([r.integers(0, 4, 33), common, r.integers(0, 4, 20), r.integers(0, 4, 11), common, r.integers(0, 4, 9)]).astype(np.uint64))
    first, length, gram = np.array([0, 113, len(codes)]), 20, 5
    row, g, _, place = anchors.find(codes, first, length, gram)
    q, low, high = anchors.unpack(place)
    of = {}
    for k in range(len(row)):
        for start in range(int(q[k] - low[k]), int(q[k] - high[k]) + 1):
            of[int(row[k]), start] = (int(g[k]), int(q[k]) - start)
    assert len(of) == sum(int(n) - length + 1 for n in np.diff(first))
    for i in range(60 - length + 1):
        assert of[0, 33 + i] == of[1, 11 + i]


def test_leftmost_min():
    r = np.random.default_rng(7)
    for width in (1, 2, 3, 7, 16, 17):
        g = r.integers(0, 5, 40).astype(np.uint64)
        assert anchors.leftmost_min(g, width).tolist() == [i + int(np.argmin(g[i : i + width])) for i in range(40 - width + 1)]


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    from recordloom.llm.store import settle

    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = settle(stage(spark, docs, SF))
        assert out.columns == docs.columns and out.schema == docs.schema
        kept = {r["doc_id"] for r in out.collect()}
        assert kept <= ids and len(kept) == out.count()
        assert name != "secrets" or kept == ids
        docs, ids = out, kept
    assert docs.where("text rlike '[0-9a-f]{32}'").count() == 0 and docs.where("n_chars <> length(text)").count() == 0
    # the mix by brute force: the words of each source's slots are those of its shuffled documents, in turn
    mixed = sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r["slot"], r["doc_id"], r["first_word"]))
    words = {r["doc_id"]: (r["source"], re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect()}
    taken: dict[int, int] = {}
    for r in mixed:
        source, all_words = words[r["doc_id"]]
        assert r["source"] == source and re.findall(r"[^\x20\x09-\x0D]+", r["text"]) == all_words[r["first_word"] : r["first_word"] + r["n_words"]]
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["n_words"]
    assert all(n <= 2 * len(words[k][1]) for k, n in taken.items())
    assert taken == {r["doc_id"]: r["taken"] for r in mixing.mix_digest(docs).collect() if r["taken"]}


def test_near_duplicate_stage_loses_no_text(spark):
    r = random.Random(3)
    a, b, c = (words(r, 80) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "w"), (2, b + " tail", "y"), (None, c, "z"), (None, c, "z"), (None, a + " end", "z"), (3, None, "n"), (4, "", "n"), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row_key", F.lit(1))
    for _ in range(2):
        kept = corpus_pipeline.near_duplicate_stage(spark, docs.repartition(3, F.rand()), SF).collect()
        heads = sorted((r["text"] or "")[:20] for r in kept)
        assert heads == sorted([a[:20], b[:20], c[:20], "", "", ""])
        first = {tuple(map(str, r)) for r in kept}
        again = {tuple(map(str, r)) for r in corpus_pipeline.near_duplicate_stage(spark, docs.orderBy(F.rand()), SF).collect()}
        assert first == again


def test_pipeline_edges(spark, tmp_path):
    spark.createDataFrame([(7, 1, 0), (4, 1, 1), (13, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (edge_docs(spark), empty_docs(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
            stage(spark, docs, str(tmp_path)).count()
        assert corpus_pipeline.mixing_stage(spark, docs, "").count() >= 0
    bare = corpus_pipeline.secret_stage(spark, edge_docs(spark).drop("n_chars"), "")
    assert "n_chars" not in bare.columns and bare.count() == len(edge_rows())
    kept = corpus_pipeline.near_duplicate_stage(spark, edge_docs(spark), str(tmp_path)).collect()
    texts = [r["text"] for r in kept]
    base = next(r[1] for r in edge_rows() if r[0] == 7)
    assert sum(t is not None and t.lower()[:40] == base[:40] for t in texts) == 1 and sum(r["doc_id"] == 18 for r in kept) == 2
