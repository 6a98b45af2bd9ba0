"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

The mix has as many slots of `block_words` words as its targets fill.  Slot t has the golden-ratio
point frac(t * phi); the source whose interval of cumulative target shares holds that point owns the
slot.  The k-th slot of a source takes the k-th block of that source's documents, which stand in a
fixed shuffled order and repeat once all are used.  The schedule alone decides how many blocks, hence
words, a source gives: its slots, at most `ceiling` times its words.  Points of low discrepancy keep
that within a few blocks of the target, from any starting slot on.

Edge cases: a null text has size 0 and no words; a null source is a source of its own and sorts
last; null ids and repeated rows are mixed as rows of their own; an empty table gives an empty mix;
only doc_id, text and source are read, so other columns may have any name.  Targets are windows over
one row a source.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.store import settle

WORD = r"[^\x20\x09-\x0D]+"
#: 2**32 divided by the golden ratio; odd, so 2**32 steps visit every point.
GOLDEN = 2654435769
SEGMENT = 4096
#: Blocks have at most this many words, and fewer in a mix of fewer words than fill LEAST_SLOTS of them.
BLOCK_WORDS, LEAST_SLOTS = 2048, 1 << 16


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """row, doc_id, source, size and the shuffled order of every document, and columns `more`, settled for reuse."""
    order = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    return settle(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            order.alias("ord"),
            *more,
        )
    )


def targets(sized: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """source, sid, source_size and target: shares by weight, none above `ceiling` times its size.

    Sources in order of ceiling per weight are full one after another; those that remain share what
    is left by weight.  Works on one row a source, so the ordering windows are small.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", "sid")
    per = per.withColumn("sid", F.row_number().over(by_name).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumns({"w": weight, "cap": F.col("source_size") * F.lit(float(ceiling)), "total": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))})
    per = per.withColumn("fill", F.col("cap") / F.col("w"))
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("full", F.col("cap") * F.sum("w").over(after) <= F.col("w") * (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))))
    whole = Window.partitionBy()
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * (left / open_w)))
    return per.select("source", "sid", "source_size", target.alias("target"), F.floor(target + 0.5).alias("quota"))


def slot_count(per: DataFrame, block_words: int | None) -> tuple[int, int]:
    """Slots of the mix and words of a block."""
    words = int(per.agg(F.sum("quota")).first()[0] or 0)
    block_words = block_words or max(1, min(BLOCK_WORDS, words // LEAST_SLOTS))
    return -(-words // block_words), block_words


def schedule(per: DataFrame, slots: int) -> DataFrame:
    """(slot, sid, block): the source that owns each slot, and how many slots it has before."""
    bound = lambda rows: F.floor(F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, rows)) / F.sum("quota").over(Window.partitionBy()) * F.lit(float(1 << 32)))
    marks = per.where("quota > 0").select("sid", F.coalesce(bound(-1), F.lit(0)).alias("lo"), bound(0).alias("hi")).where("lo < hi")
    cells = marks.select("sid", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", 22), F.shiftright(F.col("hi") - 1, 22))).alias("cell"))
    point = F.pmod(F.pmod(F.col("id"), F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(1 << 32))
    points = per.sparkSession.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.shiftright("point", 22))
    owned = points.join(cells, "cell").where("point >= lo and point < hi").select("slot", "sid", F.floor(F.col("slot") / SEGMENT).alias("segment"))
    # rank slots within a source: by segment, after the number of its slots in earlier segments
    counts = owned.groupBy("sid", "segment").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = owned.join(ahead.select("sid", "segment", "ahead"), ["sid", "segment"])
    return ranked.select("slot", "sid", (F.col("ahead") + F.row_number().over(Window.partitionBy("sid", "segment").orderBy("slot")) - 1).alias("block"))


def pieces(sized: DataFrame, per: DataFrame, slots: DataFrame, block_words: int, epochs: int) -> DataFrame:
    """(row, doc_id, sid, block, first_word, n_words): the parts of documents that fall in each block that has a slot.

    Places within a source are sums over ranges of the shuffled order, then within one range, so no
    task gets a whole source.
    """
    given = slots.groupBy("sid").agg((F.count("*") * block_words).alias("slot_words"))
    per = per.join(given, "sid").select("source", "sid", "source_size", F.least("slot_words", F.col("source_size") * epochs).alias("gives"))
    rows = sized.join(per, sized["source"].eqNullSafe(per["source"])).select("row", "doc_id", "sid", "size", "ord", "source_size", "gives")
    rows = rows.withColumn("segment", F.shiftright("ord", 48))
    sums = rows.groupBy("sid", "segment").agg(F.sum("size").alias("n"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where("size > 0").join(ahead.select("sid", "segment", "ahead"), ["sid", "segment"])
    within = Window.partitionBy("sid", "segment").orderBy("ord", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("place", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.select("*", F.explode(F.array(*[F.lit(e).cast("long") for e in range(epochs)])).alias("epoch"))
    rows = rows.withColumn("begin", F.col("place") + F.col("epoch") * F.col("source_size")).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("gives"))).where("begin < end")
    rows = rows.select("row", "doc_id", "sid", "begin", "end", F.explode(F.expr(f"sequence(begin div {block_words}, (end - 1) div {block_words})")).alias("block"))
    first = F.greatest(F.col("begin"), F.col("block") * block_words)
    return rows.select("row", "doc_id", "sid", "block", (first - F.col("begin")).alias("first_word"), (F.least(F.col("end"), (F.col("block") + 1) * block_words) - first).alias("n_words"))


def mix(docs: DataFrame, *more: str, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, ceiling: int = 2, block_words: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix (slot, row, doc_id, first_word, n_words), the sized rows with columns `more`, and the sources' targets.

    `share` is the mix's words as a multiple of all words; no source gives more than `ceiling` times
    its words, so that none of its documents is used more often.
    """
    sized = sizes(docs, *more)
    per = settle(targets(sized, weights, share, ceiling))
    n_slots, block_words = slot_count(per, block_words)
    slots = settle(schedule(per, n_slots))
    mixed = pieces(sized, per, slots, block_words, ceiling).join(slots, ["sid", "block"]).select("slot", "row", "doc_id", "first_word", "n_words")
    return mixed, sized, per


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken; the first slot that it is in, and its parts in all slots."""
    mixed, sized, per = mix(docs, **options)
    taken = mixed.groupBy("row").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_parts"))
    rows = sized.join(per, sized["source"].eqNullSafe(per["source"])).select("row", "doc_id", "size", "source_size", "target")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", zero("taken"), "first_slot", zero("n_parts"))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: slot, doc_id, source, first_word, n_words, text.

    A part that is a whole document has its text; of others the words are joined by one space.  Rows
    are ordered by (slot, doc_id, first_word) within files of consecutive slots.
    """
    mixed, sized, _ = mix(docs, "text", **options)
    parts = mixed.groupBy("row").agg(F.collect_list(F.struct("slot", "first_word", "n_words")).alias("parts"))
    # words are split once for a document, and only where it is cut: as the one element of an array they are bound to a name
    words = F.when(F.exists("parts", lambda p: p["n_words"] < F.col("size")), F.split(F.ltrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"))

    def cut(w: Column, p: Column) -> Column:
        some = F.array_join(F.slice(w, (p["first_word"] + 1).cast("int"), p["n_words"].cast("int")), " ")
        return F.struct(p["slot"].alias("slot"), p["first_word"].alias("first_word"), p["n_words"].alias("n_words"), F.when(p["n_words"] == F.col("size"), F.col("text")).otherwise(some).alias("text"))

    cuts = F.transform(F.array(words), lambda w: F.transform("parts", lambda p: cut(w, p)))[0]
    rows = parts.join(sized.select("row", "doc_id", "source", "size", "text"), "row").select("doc_id", "source", F.explode(cuts).alias("part"))
    rows = rows.select("part.slot", "doc_id", "source", "part.first_word", "part.n_words", "part.text")
    return rows.repartitionByRange("slot").sortWithinPartitions("slot", "doc_id", "first_word")
