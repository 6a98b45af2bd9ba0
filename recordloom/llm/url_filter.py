"""URL filters: path rules, then exact membership in a list by a Bloom filter cascade.

Level 1 of the cascade encodes the listed keys.  The unlisted keys of the corpus that pass it are
its false positives; level 2 encodes those, level 3 the listed keys that pass level 2, and so on
until a level lets nothing wrong pass.  For every key of the universe the answer is then exact, and
pages are judged without a join: the levels are a few bits a key.

Edge cases: a null url, or one without `://`, has an empty host and path, so no rule fits and its
key is the empty string.  Repeated urls are judged alike; an empty table gives an empty result; only
the named columns are read, so others may have any name.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.store import settle, unused

BITS_PER_KEY = 16
PROBES = 4
#: Bytes of all levels that are broadcast at once; a larger cascade is split by key and passed in parts.
MAX_BROADCAST = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty where there is no `://`."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Of (verdict, host, path) rules, the longest that fits: its text and its verdict, else null."""
    text = verdict = F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def _hash_np(h: np.ndarray, level: int) -> np.ndarray:
    x = h.view(np.uint64) ^ np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _probe(h: np.ndarray, level: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key and the bits that it sets there."""
    x = _hash_np(h, level)
    mask = np.zeros(len(h), np.uint64)
    for p in range(PROBES):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * p)) & np.uint64(63))
    return ((x >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), mask


class Cascade:
    """Levels of one part of the keys: bitmaps that alternate between listed and false positives."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels

    def __contains__(self, h: int) -> bool:
        return bool(self.test(np.array([h], np.int64))[0])

    def test(self, h: np.ndarray) -> np.ndarray:
        """For keys of the universe, whether each is listed."""
        inside = np.zeros(len(h), bool)
        left = np.arange(len(h))
        for level, bits in enumerate(self.levels):
            block, mask = _probe(h[left], level, len(bits))
            passes = (bits[block] & mask) == mask
            # what an odd level stops is unlisted, what an even one stops is listed
            inside[left[~passes]] = level % 2 == 1
            left = left[passes]
        inside[left] = len(self.levels) % 2 == 1
        return inside


def _bitmap(keys: DataFrame, level: int, n: int) -> np.ndarray:
    """The bitmap of a level: every task sets the bits of its keys, and equal blocks are or-ed before and after a shuffle."""
    blocks = max(1, n * BITS_PER_KEY // 64)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, mask = _probe(b.column(0).to_numpy(), level, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(mask.view(np.int64))], ["block", "mask"])

    rows = keys.select("h").mapInArrow(bits, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toPandas()
    out = np.zeros(blocks, np.uint64)
    out[rows["block"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def build_cascade(universe: DataFrame) -> Cascade:
    """The cascade of a table (h long, listed boolean) with one row for each key hash.

    Each level is about BITS_PER_KEY bits for each key that it encodes, and about one key in a
    hundred passes wrongly to the next, so that few levels are needed and all shrink.  Every level has
    other hash functions, so that different hashes part at some level.
    """
    spark = universe.sparkSession
    levels: list[np.ndarray] = []
    counts = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    inside, n = universe.where("listed"), counts.get(True, 0)
    outside = universe.where("not listed")
    while n:
        level = len(levels)
        levels.append(_bitmap(inside, level, n))
        bits = spark.sparkContext.broadcast(levels[-1])

        def passed(batches: Iterator[pa.RecordBatch], level: int = level, bits: Broadcast = bits) -> Iterator[pa.RecordBatch]:
            for b in batches:
                block, mask = _probe(b.column(0).to_numpy(), level, len(bits.value))
                yield b.filter(pa.array((bits.value[block] & mask) == mask))

        wrong = settle(outside.select("h").mapInArrow(passed, "h long"))
        bits.destroy()
        inside, outside, n = wrong, inside, wrong.count()
    return Cascade(levels)


def listed_flags(rows: DataFrame, key: str, listed: DataFrame, out: str = "listed", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """`rows` with a boolean column `out`: whether the string column `key` is in `listed` (column `key`).

    The universe is every key of `rows`, so the answer is exact for each of them.  The largest level
    encodes the listed keys, or those of the others that pass the first level, of which at most one in
    fifty is expected.  If the levels would exceed `max_broadcast` bytes, keys are split by hash and each
    part has its own cascade and its own pass over the rows of that part.  Keys whose 64-bit hashes are
    equal although only some are listed are left out of the cascade and held as strings; they are about
    as many as the square of the keys over 2**65.
    """
    h, k = unused(rows, "h", "k")
    keys = rows.select(F.coalesce(F.col(key), F.lit("")).alias("k")).distinct()
    known = listed.select(F.col("key").alias("k")).where("k is not null").distinct().withColumn("listed", F.lit(True))
    every = settle(keys.join(known, "k", "left").select("k", F.xxhash64("k").alias("h"), F.coalesce("listed", F.lit(False)).alias("listed")))
    universe = settle(every.groupBy("h").agg(F.bool_or("listed").alias("listed"), F.bool_and("listed").alias("all")))
    mixed = universe.where("listed and not all").select("h")
    exact = {r["k"]: r["listed"] for r in every.join(mixed, "h", "left_semi").collect()}
    universe = universe.where("listed = all").select("h", "listed")
    counts = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    largest = max(counts.get(True, 0), counts.get(False, 0) // 50 if counts.get(True, 0) else 0)
    parts = max(1, -(-largest * BITS_PER_KEY // 8 * 3 // max_broadcast))
    hashed = rows.select("*", F.coalesce(F.col(key), F.lit("")).alias(k)).withColumn(h, F.xxhash64(k))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` boolean"
    done = []
    for part in range(parts):
        of = lambda c: F.pmod(F.col(c), F.lit(parts)) == part
        cascade = build_cascade(universe.where(of("h")) if parts > 1 else universe)
        levels = rows.sparkSession.sparkContext.broadcast(cascade.levels)

        def judge(batches: Iterable[pa.RecordBatch], levels: Broadcast = levels) -> Iterator[pa.RecordBatch]:
            for b in batches:
                inside = Cascade(levels.value).test(b.column(b.num_columns - 1).to_numpy())
                if exact:
                    inside = np.array([exact.get(x, y) for x, y in zip(b.column(b.num_columns - 2).to_pylist(), inside.tolist(), strict=True)], bool)
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(inside)], [*b.schema.names[:-2], out])

        part_rows = hashed.where(of(h)) if parts > 1 else hashed
        done.append(part_rows.mapInArrow(judge, schema))
    total = done[0]
    for more in done[1:]:
        total = total.unionAll(more)
    return total


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; see the module for nulls and ties.

    A url with a fitting rule gets the verdict of the longest one.  Any other is blocked if its host or
    a domain above it is listed, and else allowed.  Rules fit the host as it is returned; listed keys are
    looked up without its port and trailing dot.  There is a pass for each number of labels that listed keys have.
    """
    host, path = host_path(F.col("url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("bare", F.regexp_replace("host", r"\.?(:[0-9]*)?$", ""))
    rows = rows.select("page_id", "host", "path", "bare", rule.alias("rule"), verdict.alias("says"))
    labels = F.size(F.split("key", r"\.")).alias("labels")
    # at most as many rows as a key has labels
    depths = sorted(r["labels"] for r in listed.where("key is not null").select(labels).distinct().collect())
    found = F.lit(False)
    for n in depths:
        rows = listed_flags(rows.withColumn("domain", F.substring_index("bare", ".", -n)), "domain", listed.where(labels == n), f"listed{n}").drop("domain")
        found = found | F.col(f"listed{n}")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(found, "block").otherwise("allow")).alias("verdict"))
