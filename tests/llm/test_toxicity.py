"""Toxicity: held-out accuracy, features against a plain reading, calibration by brute force, awkward rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from recordloom.llm import textkit as tk
from recordloom.llm import toxicity as tox
from recordloom.llm.queries import queries
from tests.llm.edge import edge_docs, edge_rows, empty_docs

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries()["op12_toxicity"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in label]
    toxic, clean = ([r["predicted"] for r in held if label[r["doc_id"]] == y] for y in (1, 0))
    assert len(toxic) > 100 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)


LEXICON = tox.Lexicon(["réeuxment", "snurk"], ["réeux", "blorgo"])
TEXTS = [
    None, "", " \t\n", "!!! ??? 12 --", "You are an idiot, YOU MORON!! really?!", "a perfectly calm text without anything", "i d i o t said he , s n u r k", "1d10t and st*pid m0r0n; l00000ser", "Réeuxxy réeuxment réeu blorgoblorgo",
    "x " * 200 + "tu es un idiot " + "y " * 200 + "trash trash trash", "日本語 idiot テキスト", "é" * 50 + " " + "aaa" * 9, "idiot", "idiotx xidiot id-iot \"idiot\"", "you " + "w " * 5 + "scum", "you " + "w " * 6 + "scum", "ALL CAPS SHOUT scum SCUM Scum",
]


def plain(text):
    """The features, word by word; letters are bytes, as in the module."""
    text = (text or "").encode().decode("latin-1")
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    bytes_of = lambda words: {w.encode().decode("latin-1") for w in words}
    spans = [m.span() for m in re.finditer("[A-Za-z\x80-\xff]+", text)]
    words = [text[a:b] for a, b in spans]
    insults, second, known, stems = bytes_of(tox.INSULTS), bytes_of(tox.SECOND_PERSON), bytes_of(["réeuxment", "snurk"]), bytes_of(["réeux", "blorgo"])
    fixed = [low(w) in insults for w in words]
    learnt = [low(w) in known for w in words]
    stem = [any(low(w).startswith(s) for s in stems) for w in words]
    hit = [a or b or c for a, b, c in zip(fixed, learnt, stem, strict=True)]
    at = [k for k, h in enumerate(hit) if h]
    to = [k for k, w in enumerate(words) if low(w) in second]
    near = sum(any(abs(k - j) <= tox.NEAR for j in to) for k in at)
    densest = max((sum(k <= j < k + tox.PASSAGE for j in at) for k in at), default=0)
    drawn = {tox.drawn_in(w).encode().decode("latin-1") for w in [*tox.INSULTS, "réeuxment", "snurk"] if len(tox.drawn_in(w)) >= 4}
    tokens, hidden, mixed = 0, 0, 0
    for m in re.finditer(r"[^\x20\x09-\x0d]+", text):
        w = m.group()
        edge = "".join(chr(k) for k in np.flatnonzero(tox.EDGE))
        core = w.strip(edge)
        if not core:
            continue
        tokens += 1
        lo = m.start() + len(w) - len(w.lstrip(edge))
        hi = lo + len(core)
        read = "".join(chr(tox.STANDS[ord(c)]) for c in core if tox.STANDS[ord(c)])
        read = "".join(c for k, c in enumerate(read) if k == 0 or c != read[k - 1])
        inside = sum(bool(tox.LETTER[ord(c)]) for c in core)
        mixed += 0 < inside < len(core)
        hidden += read in drawn and not any(h and lo <= a < hi for (a, _), h in zip(spans, hit, strict=True))
    runs, apart, spelt = [], 0, 0
    for k, w in enumerate([*words, "xx"]):
        if len(w) == 1:
            runs.append(w)
            continue
        if len(runs) >= 3:
            apart += 1
            spelt += low("".join(runs)) in insults | known
        runs = []
    n, chars, letters = max(len(words), 1), max(len(text), 1), max(sum(bool(tox.LETTER[ord(c)]) for c in text), 1)
    shouted = [len(w) >= 3 and all("A" <= c <= "Z" for c in w) for w in words]
    hidden += spelt
    t = max(tokens, 1)
    return [
        sum(fixed) / n, np.log1p(sum(fixed)), sum(learnt) / n, np.log1p(sum(learnt)), sum(stem) / n, np.log1p(sum(stem)), densest, hidden / t, np.log1p(hidden), len(to) / n, near / n, near / max(len(at), 1),
        sum("A" <= c <= "Z" for c in text) / letters, sum(shouted) / n, sum(a and b for a, b in zip(shouted, hit, strict=True)) / n, text.count("!") / chars, text.count("?") / chars,
        sum(a == b and a in "!?" for a, b in zip(text, text[1:], strict=False)) / chars, sum(c in "#$%&*+/<=>@[\\]^_`{|}~" for c in text) / chars,
        mixed / t, sum(bool(re.search(r"(.)\1\1", w)) for w in words) / n, apart / n, np.log1p(len(words)), sum(map(len, words)) / n,
    ]


def test_features_equal_a_plain_reading():
    r = random.Random(3)
    pieces = ["you", "idiot", "IDIOT", "1diot", "i", "d", "!", "?!", "réeuxab", "snurk", "calm", "loooser", "$$", "tu", "a-b", "\n", "scum,", "(moron)", "x1y"]
    texts = TEXTS + [" ".join(r.choice(pieces) for _ in range(r.randrange(80))) for _ in range(60)]
    got = tox.features(*tk.utf8(pa.array(texts)), LEXICON)
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(row, plain(text)), (text, row.round(4), np.round(plain(text), 4))
    alone = np.concatenate([tox.features(*tk.utf8(pa.array([t], pa.string())), LEXICON) for t in texts])
    assert np.allclose(alone, got)  # neighbours in a batch don't matter


def test_isotonic_is_the_best_rising_fit():
    r = np.random.default_rng(4)
    x, y, w = r.integers(0, 9, 40).astype(float), r.integers(0, 2, 40).astype(float), r.uniform(0.5, 2, 40)
    at, mean = tox.isotonic(x, y, w)
    assert (np.diff(at) > 0).all() and (np.diff(mean) > 0).all()
    # the greatest lower bound over ends of the least upper bound over starts of means (min-max formula)
    share = lambda lo, hi: np.average(y[(x >= lo) & (x <= hi)], weights=w[(x >= lo) & (x <= hi)])
    values = np.unique(x)
    best = {v: max(min(share(lo, hi) for hi in values[values >= v]) for lo in values[values <= v]) for v in values}
    assert sorted(set(np.round(list(best.values()), 9))) == np.round(mean, 9).tolist()


def test_trees_find_a_rule_and_scores_do_not_depend_on_order():
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 4))
    y = ((x[:, 1] > 0.5) & (x[:, 2] < 0)).astype(float)
    trees = tox.Trees.grow(x, y, np.ones(600))
    sums = trees.sums(x)
    assert ((sums > 0) == (y > 0)).mean() > 0.98
    order = r.permutation(600)
    assert np.array_equal(trees.sums(x[order]), sums[order])


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(4, 1, 1), (7, 1, 0), (7, 0, 0), (9, 0, 1), (10, None, None), (None, 1, 1), (12, 0, 0), (13, 1, 1), (14, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = tox.toxicity_digest(docs, labels).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows) and {r["held_out"] for r in rows} <= {True, False}
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1 and len({r["score"] for r in rows if r["doc_id"] in (7, 8)}) == 1
    assert sorted(map(str, rows)) == sorted(map(str, tox.toxicity_digest(docs.repartition(3), labels).collect()))  # reruns agree
    assert {r["score"] for r in tox.toxicity_digest(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in tox.toxicity_digest(docs, labels.where("toxic = 1")).collect()} == {1.0}
    assert tox.toxicity_digest(empty_docs(spark), labels).count() == 0


@pytest.mark.parametrize("copies", [400])
def test_repeated_rows_do_not_fill_the_sample(spark, copies):
    """Copies of one labelled row are one row to learn from, and leave room for the others."""
    r = random.Random(6)
    calm = lambda: " ".join(r.choice(["sun", "tree", "river", "stone", "walk", "bread"]) for _ in range(30))
    rows = [(1, "you idiot and moron " + calm())] * copies + [(k, calm() + (" you worthless scum" if k % 3 == 0 else "")) for k in range(2, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] + [(k, int(k % 3 == 0)) for k in range(2, 200)], "doc_id long, toxic int")
    sample, counts = tox.sampled(docs, labels.withColumnRenamed("toxic", "label"), 100)
    assert sample.count() == sample.select("h").distinct().count() == 100 and counts == {0: 132, 1: 67}
    got = {x["doc_id"]: x["predicted"] for x in tox.toxicity_digest(docs, labels, max_train=100).collect()}
    assert got == {1: 1} | {k: int(k % 3 == 0) for k in range(2, 200)}


def test_very_long_texts(spark):
    """A text of several chunks is one text: what stands at its end counts, and its neighbours are not touched."""
    calm = "sun tree river stone " * 120_000
    texts = ["calm", calm + "you idiot, you moron", calm, "you scum"]
    assert len(calm) > 8 * tk.CHUNK_BYTES
    got = tox.features(*tk.utf8(pa.array(texts)), LEXICON)
    assert got[:, 1].round(6).tolist() == np.log1p([0, 2, 0, 1]).round(6).tolist() and got[:, 6].tolist() == [0, 2, 0, 1] and got[2, 0] == 0
    rows = [(k, "you worthless scum " + "word " * k if k % 3 == 0 else "word of peace " * (1 + k % 5) + str(k)) for k in range(90)]
    docs = spark.createDataFrame(rows + [(100, texts[1]), (101, texts[2])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)], "doc_id long, toxic int")
    score = {r["doc_id"]: r["score"] for r in tox.toxicity_digest(docs, labels).collect()}
    assert score[100] >= score[101]
