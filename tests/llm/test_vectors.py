"""Clustering and whitening: brute force in whole numbers, SQL, and awkward vectors."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import clustering, whitening
from recordloom.llm import vectors as vx
from recordloom.llm.queries import oracle_sql, queries
from tests.compare import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, id int, x int, h int, cluster int, digit int, w int"


def table(spark, rows):
    return spark.createDataFrame([(k, v, *[1] * 6) for k, v in rows], SCHEMA)


def grid(v):
    return [math.floor(256 * c) for c in v]


def plain_clusters(rows, k, rounds, seed, dim):
    """(id, cluster, distance), inertias and centroids, one vector and centroid at a time."""
    kept = [(i, grid(v)) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in named[:k]]
    apart = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda x: min((apart(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        mine = [nearest(x)[1] for _, x in kept]
        for j in set(mine):
            group = [x for (_, x), m in zip(kept, mine, strict=True) if m == j]
            centroids[j] = [sum(c) // len(group) for c in zip(*group, strict=True)]
    got = [(i, *nearest(x)[::-1]) for i, x in kept]
    cut = lambda n: min(n, clustering.LARGEST)
    total = {j: sum(d for _, m, d in got if m == j) for _, j, _ in got}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, cut(d), cut(total[j]), cut(sum(total.values())), shas[j]) for i, j, d in got), key=str)


def clustered(df, **options):
    return sorted((tuple(r) for r in clustering.clusters(df, **options).collect()), key=str)


def awkward(dim, seed=1):
    r = np.random.default_rng(seed)
    rows = [(k, (r.normal(size=dim) + 3 * (k % 5)).tolist()) for k in range(150)]
    rows += [(500 + k, rows[7][1]) for k in range(60)]  # copies
    rows += [(9, rows[3][1]), (9, rows[9][1]), (None, rows[4][1]), (None, None), (600, None), (601, []), (602, [1.0] * (dim - 1)), (603, [float("nan")] + [0.0] * (dim - 1)), (604, [float("-inf")] + [0.0] * (dim - 1))]
    return rows + [(605, [None] + [0.0] * (dim - 1)), (606, [-0.0] * dim), (607, [-1 / 512] * dim)]


def test_clusters_equal_brute_force(spark):
    rows = awkward(6)
    for parts in (1, 5):
        assert clustered(table(spark, rows).repartition(parts), k=8, rounds=4, seed="2", dim=6) == plain_clusters(rows, 8, 4, "2", 6)


def test_clusters_of_wide_values(spark):
    """Entries far beyond exact doubles, and beyond a long once squared, are compared as whole numbers."""
    r = np.random.default_rng(4)
    rows = [(k, (r.normal(size=4) * 10.0 ** (3 * (k % 6))).tolist()) for k in range(60)]
    assert clustered(table(spark, rows).repartition(3), k=5, rounds=3, seed="a", dim=4) == plain_clusters(rows, 5, 3, "a", 4)


def test_clusters_of_few_vectors(spark):
    some = [(1, [0.5, 2.0]), (1, [0.5, 2.0]), (2, [1.0, 1.0])]
    assert clustered(table(spark, some), k=40, rounds=5, seed="2", dim=2) == plain_clusters(some, 40, 5, "2", 2)
    assert clustering.clusters(table(spark, []), 3, 2, "2", 64).collect() == []
    assert clustering.clusters(table(spark, [(None, [1.0])]), 3, 2, "2", 1).collect() == []


def test_clusters_equal_sql(spark):
    assert spark_rows(queries()["op11_centroids"](spark, SF)) == duck_rows(connect(SF), oracle_sql()["op11_centroids"])


def test_balls_hold_their_vectors_and_are_used():
    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(-3, 3, (300, 4)) + 400 * k for k in range(4)])
    tree, order = clustering.Tree.grow(x)
    assert sorted(order.tolist()) == list(range(len(x))) and (tree.points == x[order]).all()
    for (lo, hi), radius, total in zip(tree.bounds, tree.radii, tree.sums, strict=True):
        here = tree.points[lo:hi]
        assert (here.sum(0) == total).all() and (np.sqrt(((here - total / (hi - lo)) ** 2).sum(1)) <= radius * (1 + 1e-9) + 1e-9).all()
    centroids = np.array([[400 * k] * 4 for k in range(4)])
    balls, leaves, compared = tree.assign(centroids)
    assert sum(int(tree.counts[n]) for n, _ in balls) == len(x) and not leaves and not compared  # no vector was compared


def test_ties_go_to_the_smaller_centroid():
    tree, _ = clustering.Tree.grow(np.array([[0, 0], [10, 0], [5, 3]]))
    of, d = tree.nearest(np.array([[0, 0], [0, 0], [10, 0]]))
    assert sorted(zip(tree.points.tolist(), of.tolist(), d.tolist())) == [([0, 0], 0, 0), ([5, 3], 0, 34), ([10, 0], 2, 0)]


def test_digits_add_up(spark):
    r = np.random.default_rng(6)
    values = [0, 1, -1, 2**32, -(2**32), 2**200 + 5, -(2**90) - 7, *(int(v) ** 3 for v in r.integers(-(2**60), 2**60, 20))]
    rows = vx.digits(values, [(k % 3,) for k in range(len(values))])
    got = vx.totals(spark.createDataFrame(rows, vx.digit_schema(["k"])), ["k"])
    assert got == {(k,): sum(values[k::3]) for k in range(3)}


def plain_whitening(rows):
    """n, sums and the exact covariance of the distinct vectors."""
    xs = sorted({tuple(grid(v)) for _, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)})
    n, dim = len(xs), len(xs[0])
    sums = [sum(x[i] for x in xs) for i in range(dim)]
    mean = [Fraction(s, n) for s in sums]
    return n, sums, np.array([[float(sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in xs) / n) for j in range(dim)] for i in range(dim)])


def held(rows, df, components):
    """The whole result against a plain restatement."""
    n, sums, v = plain_whitening(rows)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    got = df.collect()
    fine = [(i, grid(x)) for i, x in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    assert len(got) == components * len(fine)
    signs = {}
    want = {(i, k): (sum((n * x[j] - sums[j]) ** 2 for j in range(len(x))), float(sum((n * x[j] - sums[j]) / n * axes[j, k - 1] for j in range(len(x))) / np.sqrt(values[k - 1]))) for i, x in fine for k in range(1, components + 1)}
    for r in got:
        deviation, w = want[r["vec_id"], r["component"]]
        assert r["n"] == n and (r["deviation"] is None if deviation >= 2**63 else r["deviation"] == deviation)
        if abs(w) > 1e-3:
            assert signs.setdefault(r["component"], r["whitened"] * w > 0) == (r["whitened"] * w > 0)
        assert abs(abs(r["whitened"]) - abs(w)) < 1e-6 * (1 + abs(w))
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / v.trace(), rel=1e-9) and r["identity_error"] <= 1e-4


def test_whitening_equals_plain_fractions(spark):
    r = np.random.default_rng(7)
    mixed = r.normal(size=(6, 6))
    rows = [(k, (r.normal(size=6) @ mixed * [9, 7, 5, 3, 2, 1] + 40).tolist()) for k in range(120)]
    rows += [(200 + k, rows[5][1]) for k in range(40)] + [(300, None), (301, [None] * 6), (302, [float("nan")] * 6)]
    held(rows, whitening.whitening_digest(table(spark, rows).repartition(5)), 4)


def test_whitening_of_values_that_doubles_would_lose(spark):
    r = np.random.default_rng(8)
    for scale, shift in ((1.0, 1e12), (1e9, 0.0), (1e15, 0.0)):  # a mean far above the spread; squares beyond a long; sums beyond a long
        rows = [(k, (r.normal(size=3) * [3 * scale, 2 * scale, scale] + shift).tolist()) for k in range(50)]
        held(rows, whitening.whitening_digest(table(spark, rows).repartition(3)), 3)


def test_whitening_edges(spark):
    assert whitening.whitening_digest(table(spark, [])).collect() == []
    assert whitening.whitening_digest(table(spark, [(1, []), (2, None)])).collect() == []
    assert whitening.whitening_digest(table(spark, [(1, [1.0, 2.0])] * 4)).collect() == []  # one distinct vector has no variance
    flat = [(k, [float(k % 7), 2.0 * (k % 7), 1.0]) for k in range(20)]
    rows = whitening.whitening_digest(table(spark, [*flat, (None, flat[0][1]), (1, flat[3][1]), (77, [1.0])])).collect()
    assert {r["component"] for r in rows} == {1} and len(rows) == 22 and rows[0]["n"] == 7  # a line has one component
    assert sum(r["vec_id"] is None for r in rows) == 1 and sum(r["vec_id"] == 1 for r in rows) == 2


def test_whitening_query(spark):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    held(rows, queries()["op13_whitening"](spark, SF), 4)
