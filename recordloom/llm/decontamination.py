"""Benchmark decontamination by greedy string tiling.

Texts are compared as words: runs of letters and digits, case folded for ASCII and Latin-1.  A
document and a test item are a pair if they share a seed of `seed` consecutive words.  In a pair,
the longest match not yet covered is marked again and again, down to matches of `seed` words; a
Karp-Rabin pass finds the matches of each length from rolling hashes.  The tiles' share of the
item's words is its coverage, whatever their order, so reordered passages count in full.

Seeds are held as a sorted array of about MAX_SEEDS hashes at most, which is broadcast; more items are
passed in parts of that size, each over all documents, which are read once a part and never written.  Parts
are made one at a time, and released once what they found is written.  Items with equal text are tiled
as one.  Pairs whose shared seeds cover less of the item than is asked for are not tiled.

Edge cases: null and empty texts have no words and match nothing; an item of fewer than `seed` words
is matched as a whole; repeated documents or items pair separately; items without an id take no part in
`contaminated` and `clean`; without items or documents the result is empty; other columns may have any name.
"""

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import textkit as tk
from recordloom.llm.store import settle, unused
from recordloom.llm.textmap import add_columns, emit_rows

SEED, COVERAGE = 5, 0.5
#: 16 bytes each: at most 16 MB are broadcast at once.
MAX_SEEDS = 1 << 20
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the folded words of each row, and the index of each row's first word."""
    starts, ends, first = tk.spans(_ALNUM[data], at)
    folded = tk.LOWER[data]
    if len(data) > 1:  # capital letters of Latin-1 in UTF-8
        high = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        folded[1:][high] += 0x20
    return tk.RangeHash(tk.BYTE_CODE[folded])(starts, ends), first


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, words): longest first, then first in doc and item, none overlapping."""
    tiles = []
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    hash_doc, hash_item = tk.RangeHash(doc), tk.RangeHash(item)

    def open_windows(free: np.ndarray, width: int) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(taken[width:] == taken[:-width]) if len(free) >= width else np.zeros(0, np.int64)

    def common(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d, i = open_windows(free_doc, width), open_windows(free_item, width)
        hd, hi = hash_doc(d, d + width), hash_item(i, i + width)
        return d, i, hd, hi

    width = min(len(doc), len(item))
    while width >= least:
        # the longest width that still matches, by bisection: a match has matches of every shorter width
        low, high, found = least, width, 0
        while low <= high:
            mid = (low + high) // 2
            _, _, hd, hi = common(mid)
            if np.isin(hi, hd).any():
                found, low = mid, mid + 1
            else:
                high = mid - 1
        if not found:
            break
        width = found
        d, i, hd, hi = common(width)
        where: dict[int, deque[int]] = {}
        for at, h in zip(i.tolist(), hi.tolist(), strict=True):
            where.setdefault(h, deque()).append(at)
        hit = np.isin(hd, hi)
        for at, h in zip(d[hit].tolist(), hd[hit].tolist(), strict=True):
            if not free_doc[at : at + width].all():
                continue
            places = where[h]
            while places:  # a place that is taken stays taken, so that each is tried once
                to = places.popleft()
                if free_item[to : to + width].all():
                    free_doc[at : at + width] = free_item[to : to + width] = False
                    tiles.append((at, to, width))
                    break
        width -= 1
    return tiles


class Items:
    """The words of some test items and the sorted hashes of their seeds."""

    def __init__(self, ids: list[int], texts: list[str | None], seed: int) -> None:
        codes, first = tokens(*tk.utf8(pa.array(texts, pa.string())))
        keep = [k for k in range(len(ids)) if first[k + 1] > first[k]]
        self.ids = [ids[k] for k in keep]
        self.words = [codes[first[k] : first[k + 1]] for k in keep]
        # items too short for a seed are searched as whole sequences, by their own length
        by_width: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            by_width.setdefault(min(seed, len(w)), []).append(k)
        self.seeds = {}
        for width, owners in by_width.items():
            h, owner, place = [], [], []
            for k in owners:
                start = np.arange(len(self.words[k]) - width + 1)
                h.append(tk.RangeHash(self.words[k])(start, start + width))
                owner.append(np.full(len(start), k))
                place.append(start)
            h, owner, place = np.concatenate(h), np.concatenate(owner), np.concatenate(place)
            order = np.argsort(h, kind="stable")
            self.seeds[width] = h[order], owner[order], place[order]

    def pairs(self, codes: np.ndarray, first: np.ndarray, coverage: float) -> list[tuple[int, int]]:
        """(row, item) whose shared seeds cover enough of the item for tiles to do so: tiles consist of shared seeds."""
        out: list[tuple[int, int]] = []
        h = tk.RangeHash(codes)
        size = np.array([len(w) for w in self.words])
        for width, (seeds, owner, place) in self.seeds.items():
            start, row = tk.windows(codes, first, width)
            code = h(start, start + width)
            low = np.searchsorted(seeds, code)
            hit = np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == code)
            # each seed once for a row
            key = np.unique(np.stack([row[hit], low[hit]], 1), axis=0)
            many = np.searchsorted(seeds, seeds[key[:, 1]], "right") - key[:, 1]
            at = np.repeat(key[:, 1] - np.cumsum(many) + many, many) + np.arange(many.sum())
            row, item, where = np.repeat(key[:, 0], many), owner[at], place[at]
            order = np.lexsort((where, item, row))
            row, item, where = row[order], item[order], where[order]
            same = (row[1:] == row[:-1]) & (item[1:] == item[:-1])
            new = np.concatenate([[True], ~same])[: len(row)]
            covers = np.concatenate([[width], np.where(same, np.minimum(np.diff(where), width), width)])[: len(row)]
            begin = np.flatnonzero(new)
            covered = np.add.reduceat(covers, begin) if len(begin) else covers
            enough = covered >= coverage * size[item[begin]]
            out += zip(row[begin][enough].tolist(), item[begin][enough].tolist(), strict=True)
        return sorted(out)


def texts_of(items: DataFrame) -> DataFrame:
    """(text, item): the different texts of the items, numbered; an id may have several, and a text several ids."""
    named = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return settle(named.select("text").distinct().withColumn("item", F.monotonically_increasing_id()))


def item_parts(texts: DataFrame, seed: int = SEED, max_seeds: int = MAX_SEEDS) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcasts of all `texts_of` the items, in parts of about `max_seeds` characters, hence seeds, made one at a time; and whether it is the only one."""
    n_parts = max(1, -(-int(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // max_seeds))
    for part in range(n_parts):
        rows = texts.where(F.pmod(F.xxhash64("text"), F.lit(n_parts)) == part).orderBy("text").collect()
        yield texts.sparkSession.sparkContext.broadcast(Items([r["item"] for r in rows], [r["text"] for r in rows], seed)), n_parts == 1


def matches(it: Items, data: np.ndarray, at: np.ndarray, coverage: float, seed: int) -> list[tuple]:
    """(row, item_id, item_words, matched_words, n_tiles, longest_tile, coverage) of the pairs that reach `coverage`."""
    codes, first = tokens(data, at)
    found = []
    for r, k in it.pairs(codes, first, coverage):
        words = it.words[k]
        tiles = greedy_tiles(codes[first[r] : first[r + 1]], words, min(seed, len(words)))
        matched = sum(t[2] for t in tiles)
        if matched >= coverage * len(words):
            found.append((r, it.ids[k], len(words), matched, len(tiles), max(t[2] for t in tiles), matched / len(words)))
    return found


def clean(docs: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE, max_seeds: int = MAX_SEEDS) -> DataFrame:
    """The rows of `docs` that contain no test item, with all their columns.

    With several parts, each gives the digests of the texts that it finds, and one join takes these texts out.
    """
    hit_, digest = unused(docs, "hit", "digest")
    found = None
    for shared, only in item_parts(texts_of(items), seed, max_seeds):

        def flag(data: np.ndarray, at: np.ndarray, shared=shared) -> list:
            hit = np.zeros(len(at) - 1, bool)
            hit[[m[0] for m in matches(shared.value, data, at, coverage, seed)]] = True
            return [hit]

        if only:
            return add_columns(docs, "text", docs.columns, {hit_: "boolean"}, flag).where(~F.col(hit_)).select(docs.columns)
        texts = docs.where("text is not null").select("text", F.md5(F.col("text").cast("binary")).alias(digest))
        one = settle(add_columns(texts, "text", [digest], {hit_: "boolean"}, flag).where(F.col(hit_)).select(digest).distinct())
        shared.destroy()
        found = one if found is None else found.unionAll(one)
    rows = docs.withColumn(digest, F.md5(F.col("text").cast("binary")))
    return rows.join(found.distinct(), digest, "left_anti").select(docs.columns)


def contaminated(docs: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE, key: str = "doc_id", max_seeds: int = MAX_SEEDS) -> DataFrame:
    """One row for each document and test item with tiles over at least `coverage` of the item.

    Columns: the key, item_id, item_words, matched_words, n_tiles, longest_tile, coverage.
    """
    out = {"item_id": "long", "item_words": "long", "matched_words": "long", "n_tiles": "long", "longest_tile": "long", "coverage": "double"}
    done = None
    texts = texts_of(items)
    for shared, only in item_parts(texts, seed, max_seeds):

        def tile(data: np.ndarray, at: np.ndarray, shared=shared) -> tuple[np.ndarray, list]:
            found = matches(shared.value, data, at, coverage, seed)
            columns = list(zip(*found, strict=True)) or [()] * 7
            ints = [np.array(c, np.int64) for c in columns[:6]]
            return ints[0], [pa.array(columns[1], pa.int64()), *ints[2:], np.array(columns[6], np.float64)]

        one = emit_rows(docs, key, out, tile)
        if not only:
            one = settle(one)
            shared.destroy()
        done = one if done is None else done.unionAll(one)
    # a text stands for all items that have it
    named = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    stands = settle(named.join(texts, "text").select("item", "item_id"))
    (item,) = unused(done, "item")
    return done.withColumnRenamed("item_id", item).join(stands.withColumnRenamed("item", item), item).select(key, *out)
