"""Near-duplicates, decontamination, neighbours and components against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import decontamination, graph, near_duplicates, neighbours
from recordloom.llm.queries import OP8_SQL, queries
from tests.compare import connect, duck_rows, spark_rows
from tests.llm.edge import edge_docs, edge_rows, empty_docs, words

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_components(rows):
    sets = [(k, shingles(t)) for k, t in rows if k is not None]
    reach = {k: {k} for k, _ in sets}
    for a, s in sets:
        for b, t in sets:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                merged = reach[a] | reach[b]
                for k in merged:
                    reach[k] = merged
    return {k: min(v) for k, v in reach.items()}


def near_copies(seed, groups=12, size=9):
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = words(r, r.randint(3, 200)).split()
        for _ in range(size):
            copy = [w if r.random() > 0.012 else f"e{r.randrange(9999)}" for w in base]
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [3, 256])
def test_near_duplicates_equal_brute_force(spark, block):
    rows = near_copies(5)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {k: len(shingles(t)) for k, t in rows}


def test_near_duplicates_edges(spark):
    got = near_duplicates.near_duplicates(edge_docs(spark)).collect()
    want = brute_components([(r[0], r[1]) for r in edge_rows()])
    assert len(got) == len(edge_rows())
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_duplicates.near_duplicates(empty_docs(spark)).count() == 0


def test_near_duplicates_query(spark):
    assert spark_rows(queries()["op8_near_duplicates"](spark, SF)) == duck_rows(connect(SF), OP8_SQL)


def test_estimates_follow_similarity():
    r = np.random.default_rng(2)
    common = r.integers(0, 2**63, 900, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common[: 300 * k], r.integers(0, 2**63, 900 - 300 * k, dtype=np.uint64)])) for k in (1, 2, 3)]
    shared, est = near_duplicates.estimates(sets, 400)
    assert shared[0, 1] == len(np.intersect1d(sets[0][:400], sets[1][:400]))
    true = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets])
    assert np.abs(est - true)[~np.eye(3, dtype=bool)].max() < 0.1


def test_a_shared_passage_makes_few_candidates(spark):
    """1,500 texts that share a passage of 60 words, at a similarity of about 0.3."""
    r = random.Random(3)
    passage = words(r, 60, 10**6)
    rows = [(k, f"{words(r, 35, 10**6)} {passage} {words(r, 35, 10**6)}") for k in range(1500)]
    sketched = near_duplicates.sketches(spark.createDataFrame(rows, "doc_id long, text string"))
    family = near_duplicates.families(near_duplicates.listed_values(sketched))
    sizes = [x["count"] for x in family.groupBy("component").count().collect()]
    assert sum(n * (n - 1) // 2 for n in sizes) < 0.01 * 1500 * 1499 / 2


def test_links_near_the_threshold_are_found(spark):
    """Pairs of texts at similarities around 0.75: the same links as brute force finds."""
    r = random.Random(12)
    rows = []
    for _ in range(400):
        base = words(r, r.randint(150, 500), 10**6).split()
        other = list(base)
        for _ in range(max(1, round(len(base) * r.uniform(0.024, 0.034)))):
            other[r.randrange(len(other))] = f"e{r.randrange(10**6)}"
        if r.random() < 0.5:
            other = base + words(r, round(len(base) * r.uniform(0.24, 0.34)), 10**6).split()
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    sets = [shingles(t) for _, t in rows]
    share = [len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, len(rows), 2)]
    assert sum(0.75 <= x <= 0.80 for x in share) > 80 and sum(0.70 <= x < 0.75 for x in share) > 40
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((got[2 * k + 1] == 2 * k) == (x >= 0.75) and got[2 * k] == 2 * k for k, x in enumerate(share))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101)] + [(200 + i, 300) for i in range(30)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == got[103] == 100 and all(got[200 + i] == 200 for i in range(30))
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def tiles_by_rule(doc, item, least):
    """Greedy string tiling without hashes."""
    doc, item, tiles = list(doc), list(item), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] is not None and doc[d + n] == item[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < least:
            return tiles
        tiles.append((d, i, n))
        doc[d : d + n], item[i : i + n] = [None] * n, [None] * n
        item = [("used", k) if x is None else x for k, x in enumerate(item)]


def test_tiles_equal_the_plain_rule():
    r = random.Random(4)
    for _ in range(60):
        item = [r.randrange(6) for _ in range(r.randint(1, 25))]
        doc = [r.randrange(6) for _ in range(r.randint(1, 30))]
        code = lambda x: np.array(x, np.uint64) * np.uint64(7919)
        got = decontamination.greedy_tiles(code(doc), code(item), 3)
        want = tiles_by_rule(doc, item, 3)
        assert max((t[2] for t in got), default=0) == max((t[2] for t in want), default=0)
        assert all(doc[d : d + n] == item[i : i + n] for d, i, n in got)
        assert len({k for d, i, n in got for k in range(i, i + n)}) == sum(t[2] for t in got)


def folded_words(text):
    """Words of letters and digits as bytes, ASCII and Latin-1 capitals folded."""
    fold = "".join(chr(ord(c) + 32) if c.isascii() and c.isupper() or "À" <= c <= "Þ" and c != "×" else c for c in text or "")
    return [w.encode("latin-1") for w in re.findall("[A-Za-z0-9\x80-\xff]+", fold.encode().decode("latin-1"))]


def contaminated_by_rule(docs, items, seed, coverage):
    """(doc_id, item_id, words, matched, tiles, longest) of every pair whose tiles by the plain rule cover enough of the item."""
    out = []
    for d, t in docs:
        for i, u in items:
            doc, item = folded_words(t), folded_words(u)
            tiles = tiles_by_rule(doc, item, min(seed, len(item))) if item else []
            matched = sum(n for _, _, n in tiles)
            if tiles and matched >= coverage * len(item):
                out.append((d, i, len(item), matched, len(tiles), max(n for _, _, n in tiles)))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_seeds", [1 << 20, 150])
def test_contaminated_equals_the_plain_rule(spark, max_seeds):
    """Seeds, coverage and result against every document tiled with every item: reordered, cut, doubled and folded passages."""
    r = random.Random(12)
    word = lambda: r.choice(["ab", "Ab", "cd", "éf", "Éf", "x1", "the", "of", "zz", "q", "ÿ"])
    items = [(k, " ".join(word() for _ in range(r.choice([1, 3, 4, 5, 6, 9, 14, 30])))) for k in range(14)] + [(3, "twice under one id, the second text of it"), (90, None), (91, " - "), (92, "same text as another item has it"), (93, "same text as another item has it")]
    docs = []
    for k in range(60):
        parts = []
        for _ in range(r.randrange(1, 4)):
            w = (r.choice(items)[1] or "").split()
            a, b = sorted((r.randrange(len(w) + 1), r.randrange(len(w) + 1))) if r.random() < 0.5 else (0, len(w))
            cut = w[a:b]
            parts.append(" ".join(cut[len(cut) // 2 :] + [word()] + cut[: len(cut) // 2]) if r.random() < 0.4 else ", ".join(cut).upper() if r.random() < 0.3 else " ".join(cut))
        docs.append((k % 50, " . ".join(parts + [word()])))
    docs += [(70, None), (71, ""), (None, items[0][1])]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(df, it, max_seeds=max_seeds)
    want = contaminated_by_rule(docs, items, 5, 0.5)
    assert sorted(((r["doc_id"], r["item_id"], r["item_words"], r["matched_words"], r["n_tiles"], r["longest_tile"]) for r in got.collect()), key=str) == want and len(want) > 20
    hit = {t for d, t in docs if contaminated_by_rule([(d, t)], items, 5, 0.5)}
    assert sorted((tuple(x) for x in decontamination.clean(df, it, max_seeds=max_seeds).collect()), key=str) == sorted((x for x in docs if x[1] not in hit), key=str)


ITEM = "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu; nu xi omicron pi rho sigma"


@pytest.mark.parametrize("max_seeds", [1 << 20, 40])
def test_decontamination(spark, max_seeds):
    items = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "Äpfel über"), (1, ITEM)], "item_id long, text string").withColumn("doc_id", F.lit(9))
    first, second, third = ITEM.split(". ")[0], ITEM.split(". ")[1].split("; ")[0], ITEM.split("; ")[1]
    rows = [(1, "xx " + ITEM + " yy"), (2, f"{third} and then {second}, but {first}"), (3, ITEM.upper().replace(" ", " \n")), (4, "alpha beta gamma delta epsilon"), (5, None), (6, ""), (7, "pre ÄPFEL, ÜBER post"), (8, "beta alpha delta gamma zeta"), (None, ITEM), (1, ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(0), "coverage": F.lit(0.0)})
    got = decontamination.contaminated(docs, items, max_seeds=max_seeds).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in got) == sorted([("1", 1)] * 4 + [("2", 1)] * 2 + [("3", 1)] * 2 + [("None", 1)] * 2 + [("7", 4)])
    assert {r["coverage"] for r in got} == {1.0}
    assert sorted(str(r["doc_id"]) for r in decontamination.clean(docs, items, max_seeds=max_seeds).collect()) == ["4", "5", "6", "8"]
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0 and decontamination.contaminated(docs.limit(0), items).count() == 0


def brute_nearest(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 100 == 0:
            out[q] = [i for _, i in sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in good if i != q)[:k]]
    return out


def test_neighbours_edges(spark):
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(150)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 1.0, 1.0]), (203, [float("nan")] * 4), (204, [float("inf"), 1.0, 1.0, 1.0]), (205, [1.0]), (206, []), (None, [1.0] * 4), (300, rows[0][1]), (301, rows[0][1])]
    got: dict[int, list] = {}
    for x in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0, list_size=16).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append(x["vec_id"])
    want = brute_nearest(rows)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 10 * len(want)
    assert got[0][:2] == [300, 301]
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert neighbours.search(none, lambda i: i % 100 == 0).count() == 0
    assert neighbours.search(spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<double>"), lambda i: i % 100 == 0).count() == 0


def test_neighbours_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in rows], float), np.array([i for i, _ in rows])
    got: dict[int, set] = {}
    for r in queries()["op7_neighbours"](spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
        a, b = x[ids == r["query_id"]][0], x[ids == r["vec_id"]][0]
        assert r["score"] == float(np.sqrt(((b - a) ** 2).sum()))
    hit = 0
    for q in got:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit += len(got[q] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert set(got) == {int(i) for i in ids if i % 100 == 0} and hit >= 0.9 * 10 * len(got)


def test_neighbours_are_exact_when_few_lists_are_probed(spark):
    r = np.random.default_rng(8)
    x = r.normal(0, 1, (3000, 16))
    x[1000:2000] = x[0]  # a third of the rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, x[5].tolist())] * 12
    # 55 lists, of which the ratio lets few be searched
    got: dict[int, list] = {}
    for w in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 100 == 0, list_size=64, recall=0.0, finish=True).orderBy("query_id", "rank").collect():
        got.setdefault(w["query_id"], []).append((w["vec_id"], w["score"]))
    x = np.vstack([x, x[5]])
    for q in range(0, 3001, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3001), d))[:10]
        assert got[q] == [(int(i), float(d[i])) for i in best]
    assert len(got) == 31


def clustered(n=6000, dim=24, groups=40, seed=10):
    """Vectors around many middles, a sixth of them one vector, so that one list is hot."""
    r = np.random.default_rng(seed)
    x = 6 * r.normal(size=(groups, dim))[r.integers(0, groups, n)] + r.normal(size=(n, dim))
    x[n // 2 : n // 2 + n // 6] = x[3]
    return x


def test_lists_carry_the_search_where_vectors_form_groups(spark, monkeypatch):
    """Without the finish, with blocks of a few vectors and queries, the lists within the measured ratio hold nearly all neighbours, and are few."""
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 7)
    x = clustered()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got: dict[int, list] = {}
    for w in neighbours.search(df, lambda i: i % 100 == 0, list_size=100, finish=False).orderBy("query_id", "rank").collect():
        got.setdefault(w["query_id"], []).append((w["vec_id"], w["score"]))
    hit = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(6000), d))[:10]
        hit += len({int(i) for i in best} & {i for i, _ in got[q]})
        assert all(s == float(d[i]) for i, s in got[q]) and got[q] == sorted(got[q], key=lambda g: (g[1], g[0]))
    assert len(got) == 60 and hit >= 0.95 * 600


def test_the_measured_ratio_is_the_least_that_holds_the_neighbours(spark):
    x = clustered(1500, 8, 12)
    points = neighbours.train_centroids(x, 39)
    lists = neighbours.squared(x, points).argmin(1)
    posted = spark.createDataFrame([(i, int(lists[i]), None, v.tolist()) for i, v in enumerate(x)], "id long, list int, far double, v array<double>")
    ratio, most = neighbours.measured_ratio(posted, x[:50], np.arange(50), points, 10, 0.9)
    far = np.sqrt(neighbours.squared(x[:50], points))
    held = []
    for q in range(50):
        d = neighbours.squared(x[q : q + 1], x)[0]
        d[q] = np.inf
        place = far[q].argsort(kind="stable").argsort(kind="stable")
        held += [place[lists[i]] < most and (place[lists[i]] < neighbours.LEAST_LISTS or far[q, lists[i]] <= ratio * far[q].min()) for i in np.lexsort((np.arange(1500), d))[:10]]
    assert np.mean(held) >= 0.9 and most <= 39


def test_centroids_in_two_levels_and_their_graph():
    r = np.random.default_rng(11)
    x = r.normal(size=(4000, 4))
    points = neighbours.train_levels(x, neighbours.ONE_LEVEL + 52)
    assert 0.8 * 2100 <= len(points) <= 2200
    sizes = np.bincount(neighbours.squared(x, points).argmin(1), minlength=len(points))
    assert sizes.max() <= 40
    c = neighbours.Centroids(points)
    right = 0
    for q in x[:60]:
        d = ((points - q) ** 2).sum(1)
        inside = np.flatnonzero(d <= 2.0**2 * d.min())
        found = {k for _, k in c.within(q, 2.0, len(points))}
        right += len(found & set(inside.tolist())) / max(1, len(inside))
    assert right >= 0.97 * 60


def test_a_query_is_met_by_every_list_that_may_matter():
    r = np.random.default_rng(9)
    points, sizes = r.normal(0, 1, (40, 3)), r.integers(0, 50, 40)
    sizes[7] = 400
    cell, parts = neighbours.pack(points, sizes, 100)
    filled = np.bincount(cell, weights=sizes)
    assert len(filled) == len(parts) and parts[cell[7]] == -(-filled[cell[7]] // 100) >= 4 and (filled <= 100 * parts).all()
