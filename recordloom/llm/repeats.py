"""Windows that repeat across a corpus: the passes that the two substring operators share.

1. Every text emits the anchors of its windows; anchors that no other place shares drop out.
2. Places with equal anchors and equal contexts share all windows of the anchor: settled by counts.
3. One place stands for each distinct context that is left, with the context's items.  Groups of
   contexts with one anchor are compared in detail within a task; a group of more than `group_size`
   contexts is dealt out window by window instead, by hash, and counted before and after a shuffle.

All groupings are hash aggregates with a join back, so that a hot anchor is summed before it is
shuffled and its rows can be split; no task needs a whole hot group.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import anchors
from recordloom.llm import textkit as tk
from recordloom.llm.store import arrow_rows, settle
from recordloom.llm.textmap import emit_rows

#: Items of some rows: bytes and row starts -> codes, index of each row's first item.
Items = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Spans travel as one long: begin and length.
SPAN_BITS = 20


@dataclass(frozen=True)
class Shape:
    """How windows are made: what items are, how many make a window and an anchor, and how big a group may be.

    `raw` items are single bytes, and contexts travel as bytes; others travel as their codes.
    """

    items: Items
    length: int
    gram: int
    group_size: int
    raw: bool

    @property
    def width(self) -> int:
        return self.length - self.gram + 1


#: Ids with several rows that are broadcast to the texts (8 bytes each); more of them are joined by a merge.
MAX_REPEATED = 1 << 18


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: where an id has several rows, the key tells their texts apart, else it is 0."""
    many = settle(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("several")))
    many = many.hint("broadcast" if many.count() <= MAX_REPEATED else "merge")
    return docs.select("doc_id", "text").join(many, "doc_id", "left").select("doc_id", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("text_key"), "text")


def places(docs: DataFrame, shape: Shape) -> DataFrame:
    """(doc_id, text_key, gram, context, place) of all anchors whose gram is at two places or more, settled."""

    def emit(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list]:
        row, gram, context, place = anchors.find(*shape.items(data, at), shape.length, shape.gram)
        return row, [tk.signed(gram), tk.signed(context), place]

    every = emit_rows(docs.where("doc_id is not null"), ["doc_id", "text_key"], {"gram": "long", "context": "long", "place": "long"}, emit)
    # settled, so that the join reads its sides straight from shuffles and a hot gram's rows can be split
    common = settle(every.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    return settle(every.join(common, "gram", "left_semi"))


def contexts(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each context: how often it occurs and its first place; and those whose gram has several contexts."""
    each = settle(found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "place")).alias("first")))
    several = settle(each.groupBy("gram").agg(F.count("*").alias("n_contexts")).where("n_contexts > 1"))
    return each, settle(each.join(several, "gram").select("gram", "n", "n_contexts", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), F.col("first.place").alias("place")))


def span(place: F.Column, shape: Shape) -> F.Column:
    """The span of a whole context, from its packed place; texts clip it at their ends."""
    q = F.shiftright(place, 2 * anchors.SHIFT)
    begin = F.greatest(q - (shape.width - 1), F.lit(0))
    return F.shiftleft(begin, SPAN_BITS).bitwiseOR(q + shape.length - begin)


def standing(docs: DataFrame, left: DataFrame, shape: Shape) -> DataFrame:
    """(gram, n, n_contexts, doc_id, start, low, codes, text_key): the items that the windows of each standing place cover.

    `start` is the place of the first window, `low` how far it is before the anchor.  Equal rows give equal results.
    """
    per_doc = left.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("gram", "n", "n_contexts", "place")).alias("wanted"))
    joined = docs.join(per_doc, ["doc_id", "text_key"]).select("doc_id", "text", "wanted", "text_key")
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tk.utf8(b.column(1))
            for start, end, part, begins in tk.chunks(data, at):
                codes, first = shape.items(part, begins)
                wanted = b.column(2).slice(start, end - start)
                rows = np.repeat(np.arange(end - start), np.diff(wanted.offsets.to_numpy()))
                flat = wanted.flatten()
                gram, n, many, place = (flat.field(k).to_numpy() for k in range(4))
                q, low, high = anchors.unpack(place)
                begin, stop = first[rows] + q - low, first[rows] + q - high + shape.length
                size = stop - begin
                if shape.raw:
                    values = pa.array([part[x:y].tobytes() for x, y in zip(begin, stop, strict=True)], pa.binary())
                else:
                    offsets = np.concatenate([[0], np.cumsum(size)])
                    pick = np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])
                    values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tk.signed(codes[pick])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(n), pa.array(many), b.column(0).take(pa.array(rows + start)), pa.array(q - low), pa.array(low), values, b.column(3).take(pa.array(rows + start))],
                    ["gram", "n", "n_contexts", "doc_id", "start", "low", "codes", "text_key"],
                )

    kind = "binary" if shape.raw else "array<bigint>"
    return joined.mapInArrow(run, f"gram long, n long, n_contexts long, doc_id long, start long, low long, codes {kind}, text_key long")


def code_rows(column: pa.Array, lookup: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All items of a column of contexts, and each one's first."""
    if lookup is None:
        return column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy().astype(np.int64) - int(column.offsets[0].as_py())
    raw = column.to_pylist()
    first = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return lookup[np.frombuffer(b"".join(raw), np.uint8)], first


def in_groups(rows: DataFrame, judge: Callable[[pa.Table], tuple[np.ndarray, ...]], batch: int = 2048) -> DataFrame:
    """Spans that `judge` finds in contexts, given whole groups: (doc_id, text_key, span).

    Rows are dealt by gram and sorted, so that groups pass in a stream; each call of `judge` gets a
    number of whole groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(table: pa.Table) -> pa.RecordBatch:
            doc, key, begin, size = judge(table)
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(key), pa.array((begin << SPAN_BITS) | size)], ["doc_id", "text_key", "span"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            gram = b.column(0).to_numpy()
            if sum(x.num_rows for x in held) < batch or gram[0] == gram[-1]:
                continue
            cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1
            yield flush(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
            held = [b.slice(cut)]
        if held:
            yield flush(pa.Table.from_batches(held))

    return rows.repartition("gram").sortWithinPartitions("gram", "doc_id", "text_key", "start").mapInArrow(run, "doc_id long, text_key long, span long")


def dealt_windows(rows: DataFrame, shape: Shape, lookup: np.ndarray | None) -> DataFrame:
    """(w1, w2, n, doc_id, text_key, start) of every window of the rows' contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, first = code_rows(b.column(6), lookup)
            start, row = tk.windows(codes, first, shape.length)
            h1, h2 = tk.RangeHash(codes), tk.RangeHash(tk.mix(codes))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tk.signed(h1(start, start + shape.length))), pa.array(tk.signed(h2(start, start + shape.length))), b.column(1).take(at), b.column(3).take(at), b.column(7).take(at), pa.array(b.column(4).to_numpy()[row] + start - first[row])],
                ["w1", "w2", "n", "doc_id", "text_key", "start"],
            )

    return rows.mapInArrow(run, "w1 long, w2 long, n long, doc_id long, text_key long, start long")


def gathered(spans: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans): all spans of each text."""
    return spans.groupBy("doc_id", "text_key").agg(F.collect_list("span").alias("spans"))


def covered(spans: pa.Array, first: np.ndarray) -> np.ndarray:
    """Which items the packed spans of each row cover."""
    n = int(first[-1])
    size = np.diff(spans.offsets.to_numpy())
    row = np.repeat(np.arange(len(spans)), size)
    packed = spans.flatten().to_numpy()
    begin = first[row] + (packed >> SPAN_BITS)
    end = np.minimum(begin + (packed & ((1 << SPAN_BITS) - 1)), first[row + 1])
    begin = np.minimum(begin, end)
    change = np.bincount(begin, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def with_spans(docs: DataFrame, spans: DataFrame, out: dict[str, str], fn: Callable[[np.ndarray, np.ndarray, pa.Array], list]) -> DataFrame:
    """doc_id and columns `out` of every text of `keyed`, computed from its bytes and its spans."""
    rows = docs.join(gathered(spans), ["doc_id", "text_key"], "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"))
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = tk.utf8(b.column(1))
            for start, end, part, begins in tk.chunks(data, at):
                made = fn(part, begins, b.column(2).slice(start, end - start))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), *(pa.array(x) for x in made)], ["doc_id", *out])

    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{k} {v}" for k, v in out.items())]))
