"""Approximate nearest neighbours with balanced posting lists.

Centroids of a bounded sample are trained by k-means that splits heavy clusters, in two levels where they
are many; every vector is posted to its nearest centroid's list, and boundary vectors also to further lists
whose centroids are nearly as near.  A query finds centroids by best-first search in an in-memory
neighbour graph and keeps the lists whose distance is within a ratio of the nearest.  The vectors and the
queries of a list are dealt into blocks that meet side by side, so no task ever gets a whole hot list.

The ratio, and how many lists are searched at most, are measured: a bounded number of queries is compared
with every row, and the least are taken that hold the asked share of their true neighbours.  Where that is
over MOST_LISTS of the lists, these do not carry the search, and it is finished exactly instead (`finish` asks for that, or
forbids it): the k-th distance found so far is a bound, and every list whose ball (centroid and radius of the
vectors nearest to it) reaches within a query's bound is compared in full, each vector once.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors
of another dimension than the sample's most frequent take none either, as they have no distance to
the others; equal distances go to the
smaller id; null ids take no part; a repeated id counts once (its first posting with the smallest
distance); an empty table, or one without queries, gives an empty result.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.store import settle

#: Centroids, the square root of the rows up to a limit, and rows to train on, so many for each: with 64 floats each these are at most 8 MB and 67 MB.
MAX_CENTROIDS, LEAST_TRAIN, TRAIN_EACH, ONE_LEVEL = 16_384, 20_000, 8, 2_048
#: Vectors, and queries, of a list that a task compares at once, lists of a vector, and how much further the others may be.
LIST_SIZE, QUERY_BLOCK, COPIES, BOUNDARY = 2_048, 4_096, 2, 1.15
GRAPH_DEGREE, LEAST_BEAM, LEAST_LISTS = 16, 32, 8
#: Queries that the ratio is measured on, the share of their neighbours that its lists hold, and the share of the lists up to which these carry the search.
MEASURED, RECALL, MOST_LISTS = 128, 0.98, 0.5
#: Of the exact finish: vectors and queries that a task compares, by their floats (16 MB) and at least, and cells that are aimed at.
CELL_FLOATS, LEAST_CELL, CELLS = 1 << 21, 1_024, 64


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `a` to all of `b`, by one product."""
    return np.maximum((a**2).sum(1)[:, None] - 2 * (a @ b.T) + (b**2).sum(1)[None, :], 0)


def train_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means whose clusters stay balanced: after each round, centroids of the lightest clusters move into the heaviest."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for step in range(rounds):
        near = np.concatenate([squared(x[i : i + 2048], c).argmin(1) for i in range(0, len(x), 2048)])
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        if step < rounds - 2:
            heavy, light = np.argsort(-size, kind="stable"), np.argsort(size, kind="stable")
            for a, b in zip(heavy[: k // 10], light[: k // 10], strict=True):
                if size[a] > 2 * len(x) / k and size[b] < len(x) / k / 2:
                    c[b] = x[rng.choice(np.flatnonzero(near == a))]
    return np.unique(c, axis=0)


def train_levels(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """About `k` balanced centroids: in two levels where they are many, each part of the first with its share of them."""
    if k <= ONE_LEVEL:
        return train_centroids(x, k, seed=seed)
    top = train_centroids(x, int(np.sqrt(k)), seed=seed)
    near = np.concatenate([squared(x[i : i + 2048], top).argmin(1) for i in range(0, len(x), 2048)])
    return np.unique(np.concatenate([train_centroids(x[near == j], max(1, round(k * (near == j).sum() / len(x))), seed=seed) for j in range(len(top)) if (near == j).any()]), axis=0)


class Centroids:
    """Centroids and their neighbour graph."""

    def __init__(self, points: np.ndarray, degree: int = GRAPH_DEGREE) -> None:
        self.points = points
        degree = min(degree, len(points) - 1)
        rows = []
        for i in range(0, len(points), 1024):
            near = squared(points[i : i + 1024], points)
            near[np.arange(len(near)), np.arange(i, i + len(near))] = np.inf
            some = np.argpartition(near, degree, axis=1)[:, : degree + 1] if degree + 1 < len(points) else np.argsort(near, axis=1)
            rows.append(np.take_along_axis(some, np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)[:, :degree])
        self.graph = np.concatenate(rows)
        # links both ways keep the graph connected in more places; entries are spread over the space
        links: list[set[int]] = [set(map(int, row)) for row in self.graph]
        for a, row in enumerate(self.graph):
            for b in row:
                links[int(b)].add(a)
        self.links = [np.array(sorted(s), np.int64) for s in links]
        self.entries = np.unique(np.linspace(0, len(points) - 1, min(16, len(points))).astype(int))

    def within(self, q: np.ndarray, ratio: float, most: int) -> list[tuple[float, int]]:
        """Of the `most` nearest centroids those within `ratio` times the distance of the nearest, and the nearest few; by a walk that is widened until it leaves that ball or has found enough."""
        beam = LEAST_BEAM
        while True:
            found = self.search(q, beam, beam)
            inside = [f for place, f in enumerate(found[:most]) if place < LEAST_LISTS or f[0] <= ratio**2 * found[0][0]]
            if len(inside) < min(len(found), most) or len(found) == len(self.points) or beam >= 2 * most:
                return inside
            beam *= 2

    def search(self, q: np.ndarray, n: int, beam: int) -> list[tuple[float, int]]:
        """The nearest centroids that a best-first walk finds: (squared distance, index), nearest first."""
        def far(k: np.ndarray) -> np.ndarray:
            return ((self.points[k] - q) ** 2).sum(1)

        seen = set(map(int, self.entries))
        todo = [(float(d), int(k)) for d, k in zip(far(self.entries), self.entries, strict=True)]
        best = [(-d, -k) for d, k in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, k = heapq.heappop(todo)
            if len(best) >= beam and d > -best[0][0]:
                break
            new = np.array([j for j in self.links[k].tolist() if j not in seen], np.int64)
            if not len(new):
                continue
            seen.update(new.tolist())
            for dj, j in zip(far(new).tolist(), new.tolist(), strict=True):
                if len(best) < beam or dj < -best[0][0]:
                    heapq.heappush(todo, (dj, j))
                    heapq.heappush(best, (-dj, -j))
                    if len(best) > beam:
                        heapq.heappop(best)
        return sorted((-d, -k) for d, k in best)[:n]


def valid(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): rows whose vector takes part, as it is stored; distances are in double precision."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def pack(points: np.ndarray, sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each list and the parts of each cell: neighbouring lists share a cell of at most `rows` vectors, a larger list has its own."""
    far = squared(points, points)
    cell, filled, left, at = np.zeros(len(points), np.int32), [0], np.ones(len(points), bool), 0
    for _ in range(len(points)):
        left[at] = False
        if filled[-1] and filled[-1] + sizes[at] > rows:
            filled.append(0)
        cell[at] = len(filled) - 1
        filled[-1] += int(sizes[at])
        at = int(np.where(left, far[at], np.inf).argmin())
    return cell, np.maximum(1, -(-np.array(filled) // rows))


def closest(v: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, bound: np.ndarray, k: int) -> tuple[list, list, list]:
    """Query id, id and distance of the `k` nearest distinct ids of each query within its bound; a product only picks whom to compare."""
    made: tuple[list, list, list] = ([], [], [])
    unique, norm = len(np.unique(ids)) == len(ids), (v**2).sum(1).max()
    step = max(1, CELL_FLOATS // len(v))
    for i in range(0, len(q), step):
        some, top = squared(q[i : i + step], v), bound[i : i + step] ** 2
        if unique and len(v) > k and not np.isfinite(top).all():
            top = np.minimum(top, np.partition(some, k, axis=1)[:, k])  # one more than k, for the query itself
        top = top + 1e-9 * (norm + (q[i : i + step] ** 2).sum(1))
        for j in range(len(some)):
            at = np.flatnonzero((some[j] <= top[j]) & (ids != qids[i + j]))
            score = np.sqrt(((v[at] - q[i + j]) ** 2).sum(1))
            order = np.lexsort((ids[at], score))
            _, first = np.unique(ids[at][order], return_index=True)
            order = order[np.sort(first)[:k]]
            made[0].extend([int(qids[i + j])] * len(order))
            made[1].extend(ids[at][order].tolist())
            made[2].extend(score[order].tolist())
    return made


def measured_ratio(posted: DataFrame, sample: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int, recall: float) -> tuple[float, int]:
    """The ratio and the number of nearest lists that together hold `recall` of the true neighbours of some queries.

    Every row is compared with these few queries; what comes to the driver is their neighbours.
    """
    shared = posted.sparkSession.sparkContext.broadcast((sample, ids))

    def best(batches):
        q, qids = shared.value
        for b in batches:
            v, own = _matrix(b.column("v")), b.column("id").to_numpy()
            if not len(v):
                continue
            at, of = [], []
            for i in range(0, len(q), 16):
                d = squared(q[i : i + 16], v)
                d[qids[i : i + 16, None] == own[None, :]] = np.inf
                # rows are in as many lists as they have copies
                keep = min(COPIES * k, len(v)) - 1
                row, col = np.nonzero((d <= np.partition(d, keep, axis=1)[:, keep : keep + 1]) & np.isfinite(d))
                at.append(col)
                of.append(np.stack([row + i, d[row, col]], 1))
            at, of = pa.array(np.concatenate(at)), np.concatenate(of)
            yield pa.RecordBatch.from_arrays([pa.array(of[:, 0].astype(np.int32)), pa.array(of[:, 1]), b.column("id").take(at), b.column("list").take(at)], ["q", "d", "id", "list"])

    found = posted.select("id", "list", "v").mapInArrow(best, "q int, d double, id long, list int").groupBy("q", "id").agg(F.min("d").alias("d"), F.collect_set("list").alias("lists"))
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("r") <= k).select("q", "lists").collect()
    if not near:
        return 1.0, 1
    far = np.sqrt(squared(sample, points))
    nearest = np.maximum(far.min(1), 1e-12)
    rank = far.argsort(1, kind="stable").argsort(1, kind="stable")
    place = np.array([rank[r["q"], r["lists"]].min() for r in near])
    apart = np.array([far[r["q"], r["lists"]].min() / nearest[r["q"]] for r in near])
    # half of what may be lost goes to the number of lists, the rest to their distance; the nearest few lists are searched whatever that is
    most = max(LEAST_LISTS, int(np.sort(place)[min(len(place) - 1, int(np.ceil((1 + recall) / 2 * len(place))))]) + 1)
    needed = np.sort(np.where(place < LEAST_LISTS, 0.0, np.where(place < most, apart, np.inf)))
    ratio = float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])
    return ratio * (1 + 1e-9), most


def search(vectors: DataFrame, is_query, k: int = 10, list_size: int = LIST_SIZE, recall: float = RECALL, finish: bool | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest of each row where `is_query` (a function of the id) holds."""
    spark = vectors.sparkSession
    rows = valid(vectors)
    out = "query_id long, rank int, vec_id long, score double"
    n = rows.count()
    wanted = max(1, min(MAX_CENTROIDS, int(np.sqrt(n)) + 1))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(LEAST_TRAIN, TRAIN_EACH * wanted)).toPandas()
    if sample.empty:
        return spark.createDataFrame([], out)
    dims = sample["v"].map(len)
    dim = int(dims.mode().iloc[0])
    sample = sample[dims == dim]
    x = np.stack(sample["v"].to_list()).astype(np.float64)
    kind = rows.schema["v"].dataType.simpleString()
    centroids = Centroids(train_levels(x, min(wanted, len(x))))
    shared = spark.sparkContext.broadcast(centroids)
    rows = rows.where(F.size("v") == dim)

    def post(batches):
        c = shared.value.points
        step = max(16, (1 << 21) // len(c))
        for b in batches:
            v = _matrix(b.column(1))
            if not len(v):
                continue
            keep = min(COPIES, len(c))
            lists, picked, far = [], [], []
            for i in range(0, len(v), step):
                d = squared(v[i : i + step], c)
                near = np.argpartition(d, keep - 1, axis=1)[:, :keep]
                dn = np.take_along_axis(d, near, 1)
                row, col = np.nonzero(dn <= BOUNDARY**2 * dn.min(1, keepdims=True))
                picked.append(row + i)
                lists.append(near[row, col])
                far.append(np.where(col == dn.argmin(1)[row], np.sqrt(dn[row, col]), np.nan))
            picked, lists, far = np.concatenate(picked), np.concatenate(lists), np.concatenate(far)
            at = pa.array(picked)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(lists.astype(np.int32)), pa.array(far, from_pandas=True), b.column(1).take(at)], ["id", "list", "far", "v"])

    # far: distance to the nearest centroid, null in the further lists
    posted = settle(rows.mapInArrow(post, f"id long, list int, far double, v {kind}"))
    ratio, most = measured_ratio(posted, x[:MEASURED], sample["id"].to_numpy()[:MEASURED], centroids.points, k, recall)
    whole = most > MOST_LISTS * len(centroids.points) if finish is None else finish

    def route(batches):
        c = shared.value
        for b in batches:
            ids, lists = [], []
            for k_, q in enumerate(_matrix(b.column(1))):
                for _, at in c.within(q, ratio, most):
                    ids.append(k_)
                    lists.append(at)
            at = pa.array(np.array(ids, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(np.array(lists, np.int32)), b.column(1).take(at)], ["qid", "list", "q"])

    asked = settle(rows.where(is_query(F.col("id"))).mapInArrow(route, f"qid long, list int, q {kind}"))
    # one row a list: the parts that its vectors and its queries are dealt into, so that every two of these meet in a task of their own
    sizes = posted.groupBy("list").agg(F.ceil(F.count("*") / list_size).cast("int").alias("parts"))
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    grid = F.broadcast(sizes.join(blocks, "list"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = posted.join(grid, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("block", each("blocks"))
    asked = asked.join(grid, "list").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).select("qid", "q", "list", "block", each("parts").alias("part"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        made = ([], [], [])
        if left.num_rows and right.num_rows:
            made = closest(_matrix(left.column("v")), left.column("id").to_numpy(), _matrix(right.column("q")), right.column("qid").to_numpy(), right.column("bound").to_numpy(), k)
        return pa.table({"query_id": pa.array(made[0], pa.int64()), "vec_id": pa.array(made[1], pa.int64()), "score": pa.array(made[2], pa.float64())})

    pairs = "query_id long, vec_id long, score double"
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        # a vector that was met in several lists counts once
        once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    asked = asked.withColumn("bound", F.lit(float("inf")))
    met = ["list", "part", "block"]
    early = ranked(dealt.groupBy(*met).cogroup(asked.groupBy(*met)).applyInArrow(nearest, pairs))
    if not whole:
        return early
    early = settle(early)

    # the exact finish; one row a list comes to the driver
    radius, held = np.full(len(centroids.points), -np.inf), np.zeros(len(centroids.points), np.int64)
    for r in posted.where("far is not null").groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radius[r["list"]], held[r["list"]] = r["far"], r["n"]
    per_cell = max(1, CELL_FLOATS // dim)
    cell, cell_parts = pack(centroids.points, held, min(per_cell, max(LEAST_CELL, n // CELLS)))
    balls = spark.sparkContext.broadcast((radius, cell, cell_parts))
    bounds = early.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).alias("bound"))
    queries = rows.where(is_query(F.col("id"))).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    queries = queries.join(bounds, F.col("qid") == F.col("query_id"), "left").select("qid", "q", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    n_blocks = max(1, -(-queries.count() // per_cell))

    def place(batches):
        _, cell, cell_parts = balls.value
        for b in batches:
            at = cell[b.column(1).to_numpy()]
            part = b.column(0).to_numpy().view(np.uint64) % cell_parts[at].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(at), pa.array(part.astype(np.int32)), b.column(3)], ["id", "cell", "part", "v"])

    def reach(batches):
        (radius, cell, cell_parts), c = balls.value, shared.value.points
        inside = np.zeros((len(c), len(cell_parts)), np.float32)
        inside[np.arange(len(c)), cell] = 1
        widest = (np.sqrt((c**2).sum(1)) + np.maximum(radius, 0)).max()
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                q = _matrix(b.column(1))
                # the slack is far above the rounding of a product
                limit = b.column(2).to_numpy() + 1e-6 * (widest + np.sqrt((q**2).sum(1)))
                near = (np.sqrt(squared(q, c)) - radius <= limit[:, None]) & np.isfinite(radius)
                row, col = np.nonzero(near.astype(np.float32) @ inside)
                times = cell_parts[col]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at = pa.array(np.repeat(row, times))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(np.repeat(col, times).astype(np.int32)), pa.array(part.astype(np.int32))], ["qid", "q", "bound", "cell", "part"])

    side = posted.where("far is not null").select(F.xxhash64("id").alias("h"), "list", "id", "v").mapInArrow(place, f"id long, cell int, part int, v {kind}")
    side = side.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    met = queries.mapInArrow(reach, f"qid long, q {kind}, bound double, cell int, part int").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n_blocks)).cast("int"))
    keys = ["cell", "part", "block"]
    late = side.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInArrow(nearest, pairs)
    return ranked(early.select("query_id", "vec_id", "score").unionByName(late))
