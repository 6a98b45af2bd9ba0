"""Substring and suffix dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from recordloom.llm import substring_dedup, suffix_dedup
from recordloom.llm.queries import OP5_SQL, OP10_SQL, queries
from tests.compare import connect, duck_rows, spark_rows
from tests.llm.edge import edge_docs, edge_rows, empty_docs, words

SF = "/root/testdata/sf0.001"


def brute_words(rows, length=20):
    docs = {}
    for k, t in rows:
        docs[k] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for k in sorted(docs):
        for i in range(len(docs[k]) - length + 1):
            first.setdefault(tuple(docs[k][i : i + length]), (k, i))
    out = {}
    for k, w in docs.items():
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (k, i):
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_words_by_row(rows, keys, length=20):
    """Sorted (doc_id, n_words, n_removed, kept_sha256), one for each row; rows of an id are ordered by the hash of their texts."""
    texts = {(k, keys[t]): re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows}
    first = {}
    for name in sorted(texts):
        for i in range(len(texts[name]) - length + 1):
            first.setdefault(tuple(texts[name][i : i + length]), (*name, i))
    out = []
    for k, t in rows:
        w, gone = texts[k, keys[t]], set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (k, keys[t], i):
                gone.update(range(i, i + length))
        out.append((k, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out)


def brute_bytes(rows, length=200):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one for each row."""
    docs = [(k, (t or "").encode()) for k, t in rows]
    seen = {}
    for _, b in docs:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for k, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def byte_rows(docs, **options):
    return sorted(map(tuple, suffix_dedup.suffix_digest(docs, **options).collect()), key=str)


def passages(seed, n=60):
    """Texts that share passages of many lengths at many places, some periodic, some hot."""
    r = random.Random(seed)
    pool = [words(r, m, 50) for m in (8, 19, 20, 21, 26, 40, 70, 120)] + ["la " * 60, "ab cd " * 30]
    rows = []
    for k in range(n):
        parts = [words(r, r.randint(0, 40), 300)]
        for _ in range(r.randint(0, 4)):
            parts += [r.choice(pool), words(r, r.randint(0, 12), 300)]
        if k % 3 == 0:
            parts.append(pool[5])
        rows.append((k * 7 % 97, " ".join(parts)))
    return rows


@pytest.mark.parametrize("group_size", [2, 1024])
@pytest.mark.parametrize("seed", [1, 2])
def test_words_equal_brute_force(spark, seed, group_size):
    rows = passages(seed)
    got = substring_dedup.substring_digest(spark.createDataFrame(rows, "doc_id long, text string"), group_size=group_size).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_words(rows)


@pytest.mark.parametrize("group_size", [2, 1024])
@pytest.mark.parametrize("most", [0, 1 << 18])
def test_words_of_repeated_ids(spark, monkeypatch, group_size, most):
    """Several rows under one id, equal or not, lose only what is repeated."""
    monkeypatch.setattr("recordloom.llm.repeats.MAX_REPEATED", most)
    r = random.Random(4)
    p, q = words(r, 40), words(r, 40)
    rows = [(1, p), (2, p), (2, q), (3, q + " " + p), (3, p + " x " + q), (3, p + " x " + q), (4, None), (4, ""), (4, q[:30]), (5, words(r, 50)), (5, words(r, 50))]
    rows += [(k % 20, t) for k, t in passages(3, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {x["text"]: x["h"] for x in docs.selectExpr("text", "xxhash64(text) as h").collect()}
    got = sorted(map(tuple, substring_dedup.substring_digest(docs, group_size=group_size).collect()))
    assert got == brute_words_by_row(rows, keys)


@pytest.mark.parametrize("group_size", [3, 16_384])
def test_bytes_equal_brute_force(spark, group_size):
    rows = passages(1)
    # ids that repeat with equal and other texts, null ids, zero bytes, and a text of several chunks
    long = words(random.Random(5), 60_000, 50_000)
    rows += [(7, rows[3][1]), (7, rows[3][1]), (7, rows[5][1] + " x"), (None, rows[9][1]), (None, rows[9][1]), (None, None), (500, "\0" * 300), (501, "ab" + "\0" * 250 + "c"), (502, long), (503, long[200_000:200_450] + "end"), (504, "é" * 150)]
    assert len(long) > 1 << 18
    assert byte_rows(spark.createDataFrame(rows, "doc_id long, text string"), group_size=group_size) == brute_bytes(rows)


def test_orders_equal_sorting():
    r = np.random.default_rng(3)
    raw = [bytes(r.integers(0, 2, r.integers(0, 40)).astype(np.uint8)) for _ in range(200)]
    group = np.sort(r.integers(0, 5, 200))
    data, first = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    order, common = suffix_dedup.msd_order(suffix_dedup.eight_bytes(data), first[:-1], np.diff(first), group, 24)
    padded = [(int(g), x[:24].ljust(24, b"\0")) for g, x in zip(group, raw, strict=True)]
    assert [padded[k] for k in order] == sorted(padded)
    for i, k in enumerate(order):
        a, b = padded[order[i - 1]], padded[k]
        want = -1 if i == 0 or a[0] != b[0] else next((n for n in range(24) if a[1][n] != b[1][n]), 24)
        assert common[i] == want


def test_edges(spark):
    once = [(r[0], r[1]) for r in edge_rows() if r[0] not in (None, 18)]
    docs = edge_docs(spark).where("doc_id <> 18 or doc_id is null")
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.substring_digest(docs).collect()}
    n_words, gone, _ = got.pop(None)
    assert got == brute_words(once) and (n_words, gone) == (300, 0)
    assert byte_rows(edge_docs(spark)) == brute_bytes([(r[0], r[1]) for r in edge_rows()])
    assert substring_dedup.substring_digest(edge_docs(spark)).count() == suffix_dedup.suffix_digest(edge_docs(spark)).count() == len(edge_rows())
    assert substring_dedup.substring_digest(empty_docs(spark)).count() == suffix_dedup.suffix_digest(empty_docs(spark)).count() == 0


def test_automaton_matching_statistics():
    r = random.Random(9)
    for _ in range(40):
        seqs = [[r.randrange(3) for _ in range(r.randint(0, 12))] for _ in range(3)]
        text = [r.randrange(3) for _ in range(15)]
        a = substring_dedup.SuffixAutomaton()
        for s in seqs:
            a.add(s)
        inside = lambda x: any(s[i : i + len(x)] == x for s in seqs for i in range(len(s) - len(x) + 1))
        want = [max(n for n in range(e + 1) if n == 0 or inside(text[e - n : e])) for e in range(1, len(text) + 1)]
        assert a.matching(text) == want


def test_substring_query(spark):
    assert spark_rows(queries()["op5_substring_dedup"](spark, SF)) == duck_rows(connect(SF), OP5_SQL)


def test_suffix_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries()["op10_suffix_dedup"](spark, SF).collect()), key=str) == brute_bytes(rows)
    assert spark_rows(queries()["op10_suffix_dedup"](spark, SF)) == duck_rows(connect(SF), OP10_SQL)
