"""Centroid clustering with partition-local ball trees.

Each task gathers its vectors into metric trees: a node is a ball with its mean, radius, count and
integer sum, and leaves hold a few vectors.  A round asks every tree for the nearest centroid of all
its vectors at once.  By the triangle inequality a centroid further from a ball's middle than the
nearest one by over twice the radius is nearest to none of its vectors; where one centroid is left,
the whole ball is its, by count and sum alone.  Other balls pass the centroids that are left to
their halves, and leaves compare them exactly, in whole numbers.

Trees are settled once and read by every round; what a round brings to the driver is one exact sum
for each centroid and dimension.

Edge cases: null vectors, those with null or non-finite entries, and those of another length take no
part; a null id is clustered, but starts no centroid; repeated rows count as often as they occur;
with fewer than `k` ids there are fewer centroids, without any the result is empty; equal distances
go to the smaller number; entries beyond a long are cut to it, and distances and inertias beyond a long
are given as the largest long; other columns may have any name.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import vectors as vx
from recordloom.llm.store import settle

#: Vectors that are split into balls together, of one tree (a row of the settled table), and of a leaf.
GATHER, TREE, LEAF = 16_384, 1_024, 16
#: Beyond this an entry's sums and distances may leave a long or a double; such vectors are one leaf.
PLAIN = float(1 << 20)
LARGEST = (1 << 63) - 1
TREES = "ids array<long>, kind string, points binary, bounds binary, halves binary, radii binary, sums binary"


class Tree:
    """A ball tree over the rows of `points`, which are ordered so that each node is a run of them."""

    def __init__(self, points: np.ndarray, bounds: np.ndarray, halves: np.ndarray, radii: np.ndarray, sums: np.ndarray) -> None:
        self.points, self.bounds, self.halves, self.radii, self.sums = points, bounds, halves, radii, sums
        self.counts = bounds[:, 1] - bounds[:, 0]
        self.middles = sums / self.counts[:, None]

    @classmethod
    def grow(cls, points: np.ndarray, leaf: int = LEAF) -> tuple["Tree", np.ndarray]:
        """The tree of some vectors, and the order that it puts them in."""
        order = np.arange(len(points))
        bounds, halves, radii, sums, todo = [], [], [], [], [(0, len(points), -1, 0)]
        plain = vx.reach(points) <= PLAIN
        while todo:
            lo, hi, parent, side = todo.pop()
            here = points[order[lo:hi]]
            at = len(bounds)
            if parent >= 0:
                halves[parent][side] = at
            bounds.append((lo, hi))
            halves.append([-1, -1])
            sums.append(here.sum(0) if plain else np.zeros(points.shape[1], np.int64))
            radii.append(float(np.sqrt(((here - sums[-1] / (hi - lo)) ** 2).sum(1).max())) if plain else np.inf)
            if plain and hi - lo > leaf and radii[-1] > 0:
                order[lo:hi] = order[lo:hi][halved(here)]
                middle = (lo + hi) // 2
                todo += [(middle, hi, at, 1), (lo, middle, at, 0)]
        return cls(points[order], np.array(bounds, np.int32), np.array(halves, np.int32), np.array(radii), np.array(sums, np.int64)), order

    def row(self, ids: pa.Array) -> list[pa.Array]:
        """The tree as a row of TREES; points take as few bytes as they need."""
        kind = next(k for k in ("int16", "int32", "int64") if k == "int64" or vx.reach(self.points) <= np.iinfo(k).max)
        data = [self.points.astype(kind), self.bounds, self.halves, self.radii, self.sums]
        return [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([kind]), *(pa.array([d.tobytes()], pa.binary()) for d in data)]

    @classmethod
    def read(cls, b: pa.RecordBatch, k: int, dim: int) -> "Tree":
        get = lambda name, kind, width: np.frombuffer(b.column(name)[k].as_py(), kind).reshape(-1, width)
        return cls(get("points", b.column("kind")[k].as_py(), dim).astype(np.int64), get("bounds", np.int32, 2), get("halves", np.int32, 2), get("radii", np.float64, 1)[:, 0], get("sums", np.int64, dim))

    def assign(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int, np.ndarray]], int]:
        """Whole balls (node, centroid), leaves as (start, end, centroid of each vector), and the vector-centroid pairs compared."""
        balls, leaves, compared = [], [], 0
        nodes, left = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        far_out = vx.reach(centroids) > PLAIN or not np.isfinite(self.radii[0])
        c = centroids.astype(np.float64)
        while len(nodes):
            if not far_out:
                d = np.sqrt(((self.middles[nodes][:, None, :] - c[None, :, :]) ** 2).sum(2))
                near = np.where(left, d, np.inf).min(1)
                # the slack is far above the rounding of these roots
                left = left & (d <= (near + 2 * self.radii[nodes] + 1e-9 * (1 + near + self.radii[nodes]))[:, None])
            one = (left.sum(1) == 1) & np.isfinite(self.radii[nodes])
            balls += zip(nodes[one].tolist(), left[one].argmax(1).tolist(), strict=True)
            end = ~one & (self.halves[nodes, 0] < 0)
            for node, some in zip(nodes[end].tolist(), left[end], strict=True):
                lo, hi = self.bounds[node]
                names = np.flatnonzero(some)
                compared += (hi - lo) * len(names)
                leaves.append((lo, hi, names[vx.squared(self.points[lo:hi], centroids[names]).argmin(1)]))
            open_ = ~one & ~end
            nodes, left = self.halves[nodes[open_]].ravel(), np.repeat(left[open_], 2, axis=0)
        return balls, leaves, compared

    def add(self, centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
        """Add each centroid's count and sum to the totals (whole numbers without bound)."""
        balls, leaves, _ = self.assign(centroids)
        for node, k in balls:
            counts[k] += int(self.counts[node])
            sums[k] += vx.whole(self.sums[node])
        for lo, hi, of in leaves:
            here = self.points[lo:hi] if np.isfinite(self.radii[0]) else vx.whole(self.points[lo:hi])
            for k in np.unique(of):
                counts[k] += int((of == k).sum())
                sums[k] += vx.whole(here[of == k].sum(0))

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid and its squared distance, a long at most."""
        balls, leaves, _ = self.assign(centroids)
        out = np.empty(len(self.points), np.int32)
        for node, k in balls:
            out[slice(*self.bounds[node])] = k
        for lo, hi, of in leaves:
            out[lo:hi] = of
        far = 4.0 * centroids.shape[1] * max(vx.reach(self.points), vx.reach(centroids)) ** 2 >= vx.EXACT
        a, b = (vx.whole(self.points), vx.whole(centroids)) if far else (self.points, centroids)
        apart = ((a - b[out]) ** 2).sum(1)
        return out, np.array([min(int(d), LARGEST) for d in apart], np.int64) if far else apart


def halved(points: np.ndarray) -> np.ndarray:
    """An order whose halves lie apart: by the line between two vectors that are far from each other."""
    one = points[((points - points[0]) ** 2).sum(1).argmax()]
    other = points[((points - one) ** 2).sum(1).argmax()]
    return np.argsort((points @ (other - one)), kind="stable")


def grown(rows: DataFrame, dim: int) -> DataFrame:
    """Trees over the vectors of (id, x), made within each partition."""

    def trees(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, x = table.column("id").chunk(0), vx.matrix(table.column("x").chunk(0), dim)
        todo = [np.arange(len(x))]
        while todo:
            mine = todo.pop()
            if len(mine) > TREE:
                order = halved(x[mine]) if vx.reach(x[mine]) <= PLAIN else np.arange(len(mine))
                todo += [mine[order[len(mine) // 2 :]], mine[order[: len(mine) // 2]]]
                continue
            tree, order = Tree.grow(x[mine])
            yield pa.RecordBatch.from_arrays(tree.row(ids.take(pa.array(mine[order]))), [c.split()[0] for c in TREES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, GATHER):
                held.append(b.slice(i, GATHER))
                n += held[-1].num_rows
                if n >= GATHER:
                    yield from trees(held)
                    held, n = [], 0
        if n:
            yield from trees(held)

    return rows.select("id", "x").mapInArrow(run, TREES)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the exact floor of the mean of their vectors; those without vectors stay."""
    k, dim = centroids.shape
    shared = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, object), np.zeros((k, dim), object)
        for b in batches:
            for i in range(b.num_rows):
                Tree.read(b, i, dim).add(shared.value, counts, sums)
        some = [j for j in range(k) if counts[j]]
        values = [v for j in some for v in (counts[j], *sums[j])]
        yield vx.digit_batch(vx.digits(values, [(j, i) for j in some for i in range(-1, dim)]), ["cluster", "place"])

    got = vx.totals(trees.mapInArrow(run, vx.digit_schema(["cluster", "place"])), ["cluster", "place"])
    out = centroids.copy()
    for j in range(k):
        if n := got.get((j, -1)):
            out[j] = [got[j, i] // n for i in range(dim)]
    return out


def clusters(vectors: DataFrame, k: int, rounds: int, seed: str, dim: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """`key`, cluster, distance of every vector, the inertias, and the hash of its centroid.

    Centroids start as the vectors with the smallest sha256 of `seed:<id>`, and move `rounds` times.
    """
    spark = vectors.sparkSession
    rows = vx.gridded(vectors, key, column).where(F.size("x") == dim)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").select(hashed.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    empty = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], empty)
    trees = settle(grown(rows, dim))
    centroids = np.array([r["x"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cluster, distance = Tree.read(b, i, dim).nearest(shared.value)
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    placed = settle(trees.mapInArrow(run, "id long, cluster int, distance long"))
    cut = lambda n: min(n, LARGEST)
    inertia = {r["cluster"]: int(r["n"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    about = [(j, cut(n), cut(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, n in inertia.items()]
    names = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    done = placed.join(F.broadcast(names), "cluster")
    return done.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
