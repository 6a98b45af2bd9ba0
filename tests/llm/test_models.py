"""Language ID, quality and secrets: held-out accuracy, plain restatements and edge cases."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import language_id, quality, secrets
from recordloom.llm import textkit as tk
from recordloom.llm.queries import queries
from tests.llm.edge import edge_docs, edge_rows, empty_docs

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op3_language_id"](spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and len(held) > 150
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    docs = edge_docs(spark)
    rows = language_id.language_digest(docs).collect()
    assert len(rows) == len(edge_rows()) and all(r["held_out"] is not None for r in rows)
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {1, 2, 3} and {r["lang_pred"] for r in rows} <= {"en", "de", "und"}
    assert {r["lang_pred"] for r in language_id.language_digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.language_digest(empty_docs(spark)).count() == 0


def test_language_of_repeated_rows(spark):
    """Copies of one labelled text neither hide their language nor another."""
    copies = [(1, "the river and the stone", "en")] * 5000
    assert {r["lang_pred"] for r in language_id.language_digest(spark.createDataFrame(copies, "doc_id long, text string, lang string")).collect()} == {"en"}
    others = [(k, f"der Fluss und der Stein {k}", "de") for k in range(2, 60)] + [(k, None, "fr") for k in range(60, 70)]
    docs = spark.createDataFrame(copies + others, "doc_id long, text string, lang string")
    sample = language_id._sample(docs, "lang", 20).collect()
    assert len(sample) <= 40 and sum(r["lang"] == "en" for r in sample) == 1 and sum(r["lang"] == "de" for r in sample) > 3
    pred = {r["doc_id"]: r["lang_pred"] for r in language_id.language_digest(docs).collect()}
    assert pred[1] == "en" and all(pred[k] == "de" for k in range(2, 60)) and all(pred[k] == "und" for k in range(60, 70))


def test_ngrams_stay_within_rows():
    data, at = tk.utf8(pa.array(["abcd", "", None, "ab", "xyz"]))
    bucket, row = language_id.ngrams(data, at)
    assert np.bincount(row, minlength=5).tolist() == [3, 0, 0, 0, 1]
    alone, _ = language_id.ngrams(*tk.utf8(pa.array(["xyz"])))
    assert alone[0] in bucket[row == 4]


def test_quality_accuracy(spark):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries()["op9_quality"](spark, SF).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in label]
    for y in (0, 1):
        mine = [r for r in held if label[r["doc_id"]] == y]
        assert sum(r["predicted"] == y for r in mine) >= 0.9 * len(mine)
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(4, 1, 0), (7, 1, 1), (7, 0, 0), (10, None, 0), (None, 1, 0), (11, 0, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality_digest(edge_docs(spark), labels).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.quality_digest(edge_docs(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.quality_digest(empty_docs(spark), labels).count() == 0


def test_quality_votes_by_brute_force():
    r = np.random.default_rng(3)
    m = quality.QualityModel(np.zeros(6), np.ones(6), np.eye(6), np.zeros((0, 6), np.float32), r.integers(0, 2, 40).astype(float))
    m.vectors = m.latent(r.normal(size=(40, 6)))
    x = r.normal(size=(10, 6))
    z = m.latent(x)
    for got, v in zip(m.score(x), z, strict=True):
        sims = m.vectors @ v
        best = np.argsort(-sims)[: quality.NEIGHBOURS]
        w = np.maximum(sims[best].astype(float), 1e-6) ** 4
        assert got == pytest.approx((w * m.labels[best]).sum() / w.sum(), rel=1e-5)


def plain_base(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    found.sort(key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))
    return found


def test_base_spans():
    cases = ["", None, "token = 'abcdefgh'", "token=short", "token=abc token=abcdefghij", "é PassWord: xY12345678 ok", "AKIA" + "A" * 12, "AKIA" + "A" * 11, "x" + "0a" * 16, "api_key=api-key=12345678", "ſecret=12345678", "secret==12345678", "é" * 50 + " token : \"" + "ab" * 20 + '"']
    for c in cases:
        assert secrets.base_spans(c or "") == plain_base(c)


def test_secret_edges(spark):
    extra = [(900, "key AKIA" + "Z" * 14 + " end"), (901, "ünï token = \"" + "0f" * 20 + "\" x")]
    docs = edge_docs(spark).select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = secrets.secret_digest(docs).collect()
    texts = [(r[0], r[1]) for r in edge_rows()] + extra
    show = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in xs)
    want = sorted((str(k), hashlib.sha256(show(plain_base(t)).encode()).hexdigest()) for k, t in texts)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in rows) == want
    for r in rows:
        base = [s for s in r["spans"].split(",") if s and not s.startswith("crf")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"] and len(base) == r["n_assign"] + r["n_access"] + r["n_hex"]
    assert secrets.secret_digest(empty_docs(spark)).count() == 0
    redacted = {r["doc_id"]: r["text"] for r in secrets.redact(docs, None).collect()}
    assert redacted[900] == "key [SECRET] end" and redacted[901] == 'ünï [SECRET]" x' and redacted[1] is None and redacted[2] == ""


VOCABULARY = ["the", "of", "Version", "2.0", "call", "+1", "555-7713", "Licensed", "therein", "ouran", "4028", "token", "key", "ring", "über", "note:", "a", "=", "password", "resets"]


def line(r):
    return " ".join(r.choice(VOCABULARY) for _ in range(20))


def trained(n, seed):
    r, rng = random.Random(seed), np.random.default_rng(seed)
    out = []
    for k in range(n):
        text, found = secrets._with_decoys(line(r), rng), []
        if k % 2:
            text, s, e = secrets._plant(text, rng)
            found = [(s, e)]
        out.append(secrets.sequence(text, found))
    return secrets.train_field(out)


def unseen(n, seed):
    """Lines with secrets and with other values in forms that training never plants."""
    r = random.Random(seed)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda k, of=mixed: "".join(r.choice(of) for _ in range(k))
    tail = lambda k: some(k - 2) + r.choice("0123456789") + r.choice("abcxyz")
    secret = [
        lambda: ("postgres://admin:", tail(20), "@db.internal"), lambda: ('"client_auth": "', tail(32), '"'), lambda: ("private_token: glpat-", tail(20), ""), lambda: ("curl -u deploy:", tail(24), " -X"),
        lambda: ("export SIGNING_KEY=", some(40, "0123456789ABCDEF") + "A1", ""), lambda: ("cookie: session=", tail(28), ";"), lambda: ("x-api-key: ", some(30, mixed[26:]) + "7q", ""), lambda: ("Basic ", tail(36), ""), lambda: ("npm_", tail(36), ""), lambda: ("AIza", tail(35), ""),
    ]
    other = [
        lambda: f"smtp{r.randrange(9)}.relay.example.org", lambda: f"www{r.randrange(9)}.city-news.co.uk", lambda: f"doi:10.{r.randrange(1000, 9999)}/journal.{r.randrange(10**6)}", lambda: f"build-{r.randrange(10**5)}-release", lambda: f"Chapter{r.randrange(99)}Section{r.randrange(9)}",
        lambda: f"{r.randrange(24):02d}:{r.randrange(60):02d}:{r.randrange(60):02d}.{r.randrange(1000):03d}", lambda: f"EUR{r.randrange(10**6)}", lambda: f"lat=-{r.randrange(90)}.{r.randrange(10**6)}", lambda: f"src/module{r.randrange(99)}/parser_test.py", lambda: f"invoice_{r.randrange(10**7)}.pdf", lambda: f"ISO{r.randrange(10**5)}:2019",
    ]
    out = []
    for k in range(n):
        words = line(r).split(" ")
        for _ in range(2):
            words.insert(r.randrange(len(words) + 1), r.choice(other)())
        at, found = r.randrange(len(words) + 1), []
        before = "".join(w + " " for w in words[:at])
        if k % 2:
            lead, value, close = r.choice(secret)()
            found = [(len(before + lead), len(before + lead + value))]
            before += lead + value + close + " "
        out.append((before + " ".join(words[at:]), found))
    return out


def test_field_on_forms_it_never_saw():
    field = trained(600, 1)
    tp = fp = fn = 0
    for text, found in unseen(400, 2):
        got = [(s, e) for k, s, e in secrets.scan_batch(*tk.utf8(pa.array([text])), field)[0] if k == "crf"]
        hit = [any(s < y and x < e for s, e in got) for x, y in found]
        tp, fn = tp + sum(hit), fn + len(hit) - sum(hit)
        fp += sum(not any(s < y and x < e for x, y in found) for s, e in got)
    assert tp / (tp + fn) >= 0.9 and tp / (tp + fp) >= 0.9, (tp, fp, fn)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_hosts_are_no_secrets(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = secrets.secret_digest(docs).where("spans like '%crf%'").join(docs.select("doc_id", "text"), "doc_id").collect()
    added = [r["text"][int(s.split(":")[1]) : int(s.split(":")[2])] for r in rows for s in r["spans"].split(",") if s.startswith("crf")]
    assert not [x for x in added if re.search(r"[a-z]\.[a-z]", x)], added


def test_long_texts_take_linear_time():
    field = trained(40, 1)
    part = "".join(f"token = {'ab1' * 5}{k} and é xY9{'kQ4z' * 5}{k} at mail{k}.example.com\n" for k in range(3000))
    seconds = []
    for n in (3, 12):
        began = time.perf_counter()
        spans = secrets.scan_batch(*tk.utf8(pa.array([part * n])), field)[0]
        seconds.append(time.perf_counter() - began)
        assert sum(k == "assign" for k, _, _ in spans) == 3000 * n
    assert len(part.encode()) * 12 > 2_500_000 and seconds[1] < 8 * seconds[0]


def test_viterbi_equals_the_plain_recursion():
    field, r = trained(60, 3), np.random.default_rng(1)
    xs = [secrets.sequence(text, [])[:2] for text, _ in unseen(50, 4)]
    xs += [(np.zeros((0, secrets.N_FLAGS)), np.zeros((0, secrets.N_HASHED), int)), (r.integers(0, 2, (300, secrets.N_FLAGS)).astype(float), r.integers(0, secrets.BUCKETS, (300, secrets.N_HASHED)))]

    def plain(flags, hashed):
        if not len(flags):
            return []
        score = flags @ field.weights + field.table[hashed].sum(1)
        best, back = field.start + score[0], []
        for s in score[1:]:
            step = best[:, None] + field.moves
            back.append(step.argmax(0))
            best = step.max(0) + s
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    first = np.concatenate([[0], np.cumsum([len(x) for x, _ in xs])])
    for lanes in (1, 7, 512):
        got = field.tags(np.concatenate([x for x, _ in xs]), np.concatenate([h for _, h in xs]), first, lanes)
        assert got.tolist() == sum((plain(*x) for x in xs), [])
