"""Suffix-array dedup of bytes: suffixes ordered only through `LENGTH` bytes, by most-significant-digit passes.

Suffixes are ordered from anchors (see `anchors`): equal windows have the same anchor at the same
place, so that a window is a stretch to the right of its anchor and one to the left of it.  A run is
what consecutive windows with one anchor cover.

1. Runs whose anchor is at no other place drop out; the others meet in groups of one anchor.
2. Within a group, runs are ordered by their real bytes right of the anchor, and again by those left
   of it (backwards), in passes over digits of eight bytes from the most significant on.  A run that
   a digit sets apart from all others drops out of the further passes.  Where neighbours in an order
   part is their common length.
3. A window that starts `a` bytes before its anchor equals another exactly if both are in one class
   of the right order at depth LENGTH - a and in one of the left order at depth a.

A group of over `group_size` runs is split by further digits first (see `split_groups`): no task gets
a whole hot group.  Hashes only say which runs meet; every repeat is found on bytes.

Edge cases: null and empty texts, and texts shorter than a window, lose nothing; null ids take part
like others; rows that repeat an id, with equal or other texts, are places of their own; bytes are
those of UTF-8, so a kept part may cut a character; an empty table gives an empty result; only doc_id
and text are read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm import anchors
from recordloom.llm import textkit as tk
from recordloom.llm.repeats import SPAN_BITS, covered
from recordloom.llm.store import arrow_rows, settle
from recordloom.llm.textmap import emit_rows

LENGTH, GRAM, GROUP = 200, 32, 16_384
#: Places of large groups, of 32 bytes each, that are broadcast to the texts (16 MB); more of them are joined by a merge.
MAX_BROADCAST = 1 << 19
RUN = "gram long, doc_id long, text_key long, start long, low int, high int, run binary"


# ---- passes over the digits of one batch of groups -----------------------------------------


def first_unequal(x: np.ndarray) -> np.ndarray:
    """How many leading bytes of each 64-bit value, not zero, are zero."""
    return sum((x >> tk.U(64 - 8 * k) == 0).astype(np.int64) for k in range(1, 8))


def msd_order(words: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by group, then by up to `depth` bytes from `begin`; and each one's common length with the one before.

    `words` has the eight bytes from each place on as a number, `size` the bytes that a row has; what is
    beyond them counts as zeros.  The first of a group has -1.
    """
    order = np.argsort(group, kind="stable")
    segment = np.cumsum(np.concatenate([[True], np.diff(group[order]) != 0])) if len(group) else np.zeros(0, np.int64)
    common = np.where(np.concatenate([[True], np.diff(segment) != 0])[: len(group)], -1, depth)
    place = np.arange(len(group))
    for at in range(0, depth, 8):
        size_of = np.bincount(segment)
        more = size_of[segment] > 1
        place, segment = place[more], segment[more]
        if not len(place):
            break
        rows = order[place]
        valid = np.clip(size[rows] - at, 0, 8)
        digit = words[np.minimum(begin[rows] + at, len(words) - 1)] & np.where(valid > 0, ~tk.U(0) << (8 * (8 - valid)).astype(tk.U), tk.U(0))
        sort = np.lexsort((digit, segment))
        order[place], digit = rows[sort], digit[sort]
        parts = (segment[1:] == segment[:-1]) & (digit[1:] != digit[:-1])
        common[place[1:][parts]] = at + first_unequal((digit[1:] ^ digit[:-1])[parts])
        segment = np.cumsum(np.concatenate([[True], (segment[1:] != segment[:-1]) | parts]))
    return order, common


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data) + 1, tk.U)
    for k in range(8):  # in place, so that few arrays of eight times the data are held
        out <<= tk.U(8)
        out |= padded[k : k + len(out)]
    return out


def repeated_windows(group: np.ndarray, data: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How far before its anchor the first and the last repeated window of each run starts; -1 without one.

    A run's bytes go from its first window, `low` before the anchor, to the end of its last, `high` before it.
    """
    n = len(group)
    anchor = first[:-1] + low
    right, right_common = msd_order(eight_bytes(data), anchor, length - high, group, length)
    left, left_common = msd_order(eight_bytes(data[::-1]), len(data) - anchor, low, group, int(low.max(initial=0)))
    most, least = np.full(n, -1), np.full(n, -1)
    in_right, in_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(int(high.min(initial=0)), int(low.max(initial=-1)) + 1):
        mine = np.flatnonzero((high <= a) & (a <= low))
        if len(mine) < 2:
            continue
        in_right[right] = np.cumsum(right_common < length - a)
        in_left[left] = np.cumsum(left_common < a)
        key = in_right[mine] * (n + 1) + in_left[mine]
        sort = np.argsort(key, kind="stable")
        same = key[sort][1:] == key[sort][:-1]
        found = mine[sort[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
        most[found] = a
        least[found] = np.where(least[found] < 0, a, least[found])
    return most, least


# ---- runs, groups and their splitting ------------------------------------------------------


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: id and key name a text wherever ids repeat; odd keys are those of null ids, which are 0 here."""
    no_id = F.col("doc_id").isNull()
    key = F.shiftleft(F.xxhash64("doc_id", "text"), 1).bitwiseOR(no_id.cast("long"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), key.alias("text_key"), "text")


def anchor_places(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, text_key, gram, place) of all anchors."""

    def emit(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list]:
        row, code, _, place = anchors.find(tk.BYTE_CODE[data], at, length, gram)
        return row, [tk.signed(code), place]

    return emit_rows(texts.where(F.octet_length("text") >= length), ["doc_id", "text_key"], {"gram": "long", "place": "long"}, emit)


def runs(texts: DataFrame, places: DataFrame, length: int, join: str = "merge") -> DataFrame:
    """The bytes of the run of each place, as RUN; `join` is how texts meet their places."""
    wanted = places.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("gram", "place")).alias("wanted")).hint(join)
    joined = texts.join(wanted, ["doc_id", "text_key"]).select("doc_id", "text_key", "wanted", "text")
    arrow_rows(texts.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tk.utf8(b.column(3))
            for start, end, part, begins in tk.chunks(data, at):
                wanted = b.column(2).slice(start, end - start)
                row = np.repeat(np.arange(end - start), np.diff(wanted.offsets.to_numpy()))
                flat = wanted.flatten()
                q, low, high = anchors.unpack(flat.field(1).to_numpy())
                begin, stop = begins[row] + q - low, begins[row] + q - high + length
                raw = part.tobytes()
                values = pa.array([raw[x:y] for x, y in zip(begin.tolist(), stop.tolist(), strict=True)], pa.binary())
                mine = pa.array(row + start)
                yield pa.RecordBatch.from_arrays(
                    [flat.field(0), b.column(0).take(mine), b.column(1).take(mine), pa.array(q - low), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), values],
                    ["gram", "doc_id", "text_key", "start", "low", "high", "run"],
                )

    return joined.mapInArrow(cut, RUN)


def judged(rows: DataFrame, length: int, batch: int = 4096) -> DataFrame:
    """(doc_id, text_key, span) of the repeated windows of runs that come with all others of their group.

    Rows are dealt by group and sorted, so that groups pass in a stream, some whole ones at a time.
    """

    def judge(table: pa.Table) -> pa.RecordBatch:
        data, at = tk.utf8(table.column("run"))
        data, first = data[at[0] : at[-1]], at - at[0]
        low, high = table.column("low").to_numpy().astype(np.int64), table.column("high").to_numpy().astype(np.int64)
        most, least = repeated_windows(table.column("gram").to_numpy(), data, first, low, high, length)
        hit = np.flatnonzero(most >= 0)
        begin = table.column("start").to_numpy()[hit] + low[hit] - most[hit]
        mine = pa.array(hit)
        named = [table.column(c).combine_chunks().take(mine) for c in ("doc_id", "text_key")]
        return pa.RecordBatch.from_arrays([*named, pa.array((begin << SPAN_BITS) | (most[hit] - least[hit] + length))], ["doc_id", "text_key", "span"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            gram = b.column(0).to_numpy()
            if sum(x.num_rows for x in held) < batch or gram[0] == gram[-1]:
                continue
            cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1
            yield judge(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
            held = [b.slice(cut)]
        if held:
            yield judge(pa.Table.from_batches(held))

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(stream, "doc_id long, text_key long, span long")


def span_of(start: Column, low: Column, high: Column, length: int) -> Column:
    return F.shiftleft(start, SPAN_BITS).bitwiseOR((low - high + length).cast("long"))


def split_groups(rows: DataFrame, length: int, width: int, group_size: int) -> DataFrame:
    """(doc_id, text_key, span) of the repeated windows of runs in groups of any size.

    Runs equal in all their bytes are counted before they are shuffled; one stands for each kind.  The
    windows' places before the anchor are then halved again and again: all windows of a half share
    the bytes between them, and these further digits split the group.  Runs that are alone with
    theirs drop out, groups that are small enough are judged, and the rest is halved again; at a
    single place the digits are the whole window.
    """
    rows = settle(rows)
    kind = ["gram", "low", "high", "run"]
    each = settle(rows.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("start", "text_key", "doc_id")).alias("at")))
    found = rows.join(each.where("n > 1").select(*kind).hint("merge"), kind, "left_semi").select("doc_id", "text_key", span_of(F.col("start"), F.col("low"), F.col("high"), length).alias("span"))
    left = each.select("gram", "at.doc_id", "at.text_key", "at.start", "low", "high", "run", F.lit(0).alias("near"), F.lit(width - 1).alias("far"))
    size = width
    while size > 1:
        middle = F.expr("(near + far) div 2").cast("int")
        halves = F.explode(F.array(F.struct(F.col("near"), middle.alias("far")), F.struct((middle + 1).alias("near"), F.col("far")))).alias("half")
        cut = left.select("*", halves).where("half.near <= half.far").drop("near", "far").select("*", "half.near", "half.far").drop("half")
        cut = cut.withColumns({"top": F.least("low", "far"), "end": F.greatest("high", "near")}).where("top >= end")
        core = F.substring("run", F.col("low") - F.col("near") + 1, F.col("near") + length - F.col("far"))
        cut = cut.select(
            F.xxhash64("gram", "near", core).alias("gram"), "doc_id", "text_key", (F.col("start") + F.col("low") - F.col("top")).alias("start"),
            F.col("top").alias("low"), F.col("end").alias("high"), F.substring("run", F.col("low") - F.col("top") + 1, F.col("top") - F.col("end") + length).alias("run"), "near", "far",
        )
        cut = settle(cut)
        counts = settle(cut.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
        met = cut.join(counts.hint("merge"), "gram")
        found = found.unionAll(judged(met.where(F.col("n") <= group_size).select(*RUN.replace(" long", "").replace(" int", "").replace(" binary", "").split(", ")), length))
        left = met.where(F.col("n") > group_size).drop("n")
        size = -(-size // 2)
        if counts.where(F.col("n") > group_size).isEmpty():
            return found
    whole = settle(left.groupBy("gram", "run").agg(F.count("*").alias("n")).where("n > 1").select("gram", "run"))
    return found.unionAll(left.join(whole.hint("merge"), ["gram", "run"], "left_semi").select("doc_id", "text_key", span_of(F.col("start"), F.col("low"), F.col("high"), length).alias("span")))


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, group_size: int = GROUP) -> DataFrame:
    """(doc_id, text_key, span): spans of every window of `length` bytes that also starts elsewhere.

    Only the places of large groups may be broadcast to the texts, and only up to MAX_BROADCAST of them.
    """
    every = settle(anchor_places(texts, length, gram))
    # settled, so that the join reads its sides straight from shuffles and a hot anchor's rows can be split
    common = settle(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    found = every.join(common.hint("merge"), "gram")
    spans = judged(runs(texts, found.where(F.col("n") <= group_size), length), length)
    in_large = common.where(F.col("n") > group_size).agg(F.sum("n")).first()[0]
    if in_large:
        join = "broadcast" if in_large <= MAX_BROADCAST else "merge"
        spans = spans.unionAll(split_groups(runs(texts, found.where(F.col("n") > group_size), length, join), length, length - gram + 1, group_size))
    return spans


def suffix_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every text."""
    texts = keyed(docs)
    spans = repeated_spans(texts, **options).groupBy("doc_id", "text_key").agg(F.collect_list("span").alias("spans")).hint("merge")
    named = F.when(F.col("text_key").bitwiseAND(F.lit(1)) == 0, F.col("doc_id")).alias("doc_id")
    rows = texts.join(spans, ["doc_id", "text_key"], "left").select(named, "text", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"))
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tk.utf8(b.column(1))
            for start, end, part, begins in tk.chunks(data, at):
                gone = covered(b.column(2).slice(start, end - start), begins)
                _, _, parts = tk.spans(gone, begins)
                total = np.concatenate([[0], np.cumsum(gone)])
                kept = [hashlib.sha256(part[x:y][~gone[x:y]].tobytes()).hexdigest() for x, y in zip(begins[:-1], begins[1:], strict=True)]
                made = [np.diff(begins), total[begins[1:]] - total[begins[:-1]], np.diff(parts), kept]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), *(pa.array(x) for x in made)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
