"""Near-duplicate texts by bottom-k sketches, exact in what they report.

1. Every text becomes its set of 5-word shingles, hashed once to 64 bits; texts with equal sets form
   a class, and one text stands for it.
2. The KEEP smallest hashes of a set are its bottom-k sketch.  Retained values that two sketches
   share are inverted lists; of each sketch only the rarest values are listed, as two sets that are
   similar enough share so many retained values that one must be among the rarest of both.  A text
   with enough values of its own, such as one that shares no more than a passage with others, is
   therefore on no list.
3. Lists that share texts are brought together and dealt into pairs of blocks.  In a pair of blocks
   the inverted lists of all retained values give the overlap of every two texts; pairs with too
   small an overlap, or that union sketches estimate to be too far apart, are left out, and the full
   sets decide the rest exactly.
4. Each pair of blocks reports a spanning forest of its links, never all pairs, and the components
   of all forests are those of all links.

Edge cases: a null, empty or blank text has no shingles and is linked with nothing; a text of one
to four words is one shingle; a null id is linked with nothing and kept; a repeated id stands for
all its texts and gets one component; an empty table gives an empty result; only the named columns
are read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm import textkit as tk
from recordloom.llm.graph import components
from recordloom.llm.store import settle
from recordloom.llm.textmap import add_columns

# LEAST_SHARE: two sketches of sets with similarity 0.75 share 72 of 96 values on average where one set holds the other,
# with a deviation of at most 4.2, and more otherwise; 52 is 4.8 deviations below
WIDTH, KEEP, LEAST_SHARE, BLOCK = 5, 96, 0.54, 512
#: An estimate from 96 values has a deviation of at most 0.044; pairs within 4.5 of them stay.
SLACK = 0.2
#: Shingles of a block: two blocks of 2 MB of hashes are compared at a time, however long their texts are.
BLOCK_SHINGLES = 1 << 18


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    starts, ends, first = tk.words(data, at)
    code, row = tk.shingle_codes(tk.word_codes(data, starts, ends, lower=True), first, width)
    edges = np.searchsorted(row, np.arange(len(at)))
    return [np.unique(code[edges[r] : edges[r + 1]]) for r in range(len(at) - 1)]


def sketches(docs: DataFrame, width: int = WIDTH, keep: int = KEEP) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and the bottom-k sketch, settled."""

    def run(data: np.ndarray, at: np.ndarray) -> list:
        sets = shingle_sets(data, at, width)
        sums = [[int(tk.signed(tk.mix(s ^ tk.U(salt)).sum(dtype=tk.U).reshape(1))[0]) for s in sets] for salt in (0, 0x5DEECE66D)]
        sketch = [tk.signed(s[:keep]) for s in sets]
        return [np.array([len(s) for s in sets], np.int64), *(np.array(x, np.int64) for x in sums), pa.array(sketch, pa.list_(pa.int64()))]

    return settle(add_columns(docs.select("doc_id", "text"), "text", ["doc_id"], {"n_shingles": "long", "h1": "long", "h2": "long", "sketch": "array<bigint>"}, run))


def listed_values(standing: DataFrame) -> DataFrame:
    """(value, doc_id): the inverted lists of the rarest retained values of every sketch, settled."""
    values = standing.select("doc_id", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    # settled, so that the joins read their sides straight from shuffles and a hot value's rows can be split
    common = settle(values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"))
    shared = values.join(common.hint("merge"), "value")
    order = Window.partitionBy("doc_id").orderBy("n", "value")
    ranked = shared.withColumns({"rank": F.row_number().over(order), "n_shared": F.count("*").over(Window.partitionBy("doc_id"))})
    # values of no other text come first in the order of rarity
    listed = ranked.where(F.col("k") - F.col("n_shared") + F.col("rank") <= F.col("k") - F.ceil(F.col("k") * LEAST_SHARE) + 1).select("value", "doc_id")
    return settle(listed)


def families(listed: DataFrame) -> DataFrame:
    """(node, component): texts of lists that have texts in common."""
    heads = settle(listed.groupBy("value").agg(F.min("doc_id").alias("v"), F.count("*").alias("n")).where("n > 1").select("value", "v"))
    return components(listed.join(heads, "value").select(F.col("doc_id").alias("u"), "v"))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share: the inverted list of every value counts one for each two sets on it.

    Lists of one set drop out; the others are counted 4,096 at a time, by a product.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    value, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.zeros((n, n), np.float32)
    useful = np.flatnonzero(count > 1)
    slot = np.full(len(value), -1)
    for a in range(0, len(useful), 4096):
        part = useful[a : a + 4096]
        slot[part] = np.arange(len(part))
        at = slot[place]
        mine = at >= 0
        x = np.zeros((n, len(part)), np.float32)
        x[owner[mine], at[mine]] = 1
        both += x @ x.T
        slot[part] = -1
    return both.astype(np.int64)


def estimates(sets: list[np.ndarray], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each two sets, how many values their sketches share, and their similarity as the union sketch shows it.

    Up to the smaller of two sketches' largest values both know all values of their sets, so these
    values are the bottom of the union; the share of them that both hold estimates the similarity.
    """
    sketch = [s[:keep] for s in sets]
    reach = np.array([s[-1] if len(full) > keep else np.iinfo(np.uint64).max for s, full in zip(sketch, sets, strict=True)], np.uint64)
    upto = np.minimum(reach[:, None], reach[None, :])
    known = np.stack([np.searchsorted(s, row, "right") for s, row in zip(sketch, upto, strict=True)])
    shared = _overlaps(sketch)
    return shared, shared / np.maximum(known + known.T - shared, 1)


def candidates(sets: list[np.ndarray], threshold: int, keep: int) -> np.ndarray:
    """Which two sets overlap in enough retained values, and are near enough by the estimate."""
    shared, estimate = estimates(sets, keep)
    size = np.minimum([len(s) for s in sets], keep)
    near = (shared >= np.ceil(np.minimum(size[:, None], size[None, :]) * LEAST_SHARE)) & (estimate >= threshold / 100 - SLACK)
    np.fill_diagonal(near, False)
    return near


def _forest(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, threshold: int, keep: int) -> list[tuple[int, int]]:
    """Spanning forest of the links of these texts; with two sides, of those across them."""
    n = len(ids)
    close = candidates(sets, threshold, keep)
    if side.any() and not side.all():
        close &= side[:, None] != side[None, :]
    left = np.flatnonzero(close.any(1))
    if not len(left):
        return []
    size = np.array([len(sets[k]) for k in left])
    shared = _overlaps([sets[k] for k in left])
    link = np.zeros((n, n), bool)
    link[np.ix_(left, left)] = 100 * shared >= threshold * (size[:, None] + size[None, :] - shared)
    link &= close
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(link, 1)), strict=True):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[a] = b
            out.append((int(ids[i]), int(ids[j])))
    return out


def links(docs: DataFrame, family: DataFrame, sizes: DataFrame, threshold: int, width: int, block: int) -> DataFrame:
    """(u, v): spanning forests of the links within each pair of blocks of each family, on full sets.

    `sizes` has doc_id and n_shingles.  A block is bounded by its texts and by their shingles.
    """
    family = family.select(F.col("node").alias("doc_id"), "component").join(sizes.groupBy("doc_id").agg(F.max("n_shingles").alias("n")), "doc_id")
    total = family.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = family.join(total, "component").select("doc_id", "component", "blocks")
    # a merge at every size: broadcasting members would pay for small inputs only
    texts = docs.select("doc_id", "text").join(members.hint("merge"), "doc_id")
    encode = lambda data, at: [[s.tobytes() for s in shingle_sets(data, at, width)]]
    sets = add_columns(texts, "text", ["doc_id", "component", "blocks"], {"shingles": "binary"}, encode)
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = sets.select("doc_id", "component", "shingles", mine.alias("mine"), met.alias("met"))
    rows = rows.select("doc_id", "shingles", "component", F.least("mine", "met").alias("low"), F.greatest("mine", "met").alias("high"), (F.col("mine") > F.col("met")).alias("side"))

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        found = _forest(ids, [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()], table.column("side").to_numpy(zero_copy_only=False), threshold, KEEP) if len(ids) > 1 else []
        return pa.table({"u": pa.array([a for a, _ in found], pa.int64()), "v": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("component", "low", "high").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, threshold: int = 75, width: int = WIDTH, keep: int = KEEP, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: link sets with 100 * intersection >= threshold * union."""
    sketched = sketches(docs, width, keep)
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = settle(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("stands")))
    in_class = settle(full.select("doc_id", "h1", "h2", "n_shingles").join(classes, ["h1", "h2", "n_shingles"]).select("doc_id", "stands"))
    standing = full.select("doc_id", "sketch").join(in_class.where("doc_id = stands").select("doc_id").distinct().hint("merge"), "doc_id")
    near = settle(links(docs, families(listed_values(standing)), full.select("doc_id", "n_shingles"), threshold, width, block))
    # classes with several ids, and ids with several texts, are links too
    edges = near.unionByName(in_class.where("doc_id <> stands").select(F.col("doc_id").alias("u"), F.col("stands").alias("v")))
    found = components(edges)
    rows = sketched.select("doc_id", "n_shingles").join(found, sketched["doc_id"] == found["node"], "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
