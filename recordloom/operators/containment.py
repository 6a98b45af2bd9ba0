"""Which of many strings a text contains, by an index of the rarest part of each string.

Where a text contains a string, it has every word of it but the first and last, which may be cut.  Runs of up to three of
these inner words are counted over all texts; each string is listed under its rarest one, and only texts with that run are
searched.  A string without inner words is listed under its rarest run of up to four characters instead.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.sources.shared import settled

RUN, SIGNS = 3, 4
#: Runs of all strings that are broadcast, about 100 bytes each; more of them are joined by a merge.
MAX_BROADCAST = 1 << 18


def _grams(words: Column, n: Column) -> Column:
    """Runs of `n` words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.array_join(F.slice(words, k, n), " ")))


def _signs(text: Column, n: Column) -> Column:
    """Runs of `n` characters."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substring(text, k, n)))


def contained_strings(texts: DataFrame, text_id: str, text: str, strings: DataFrame, string_id: str, string: str) -> DataFrame:
    """(text_id, string_id) of every text that contains a string; null texts, and null and empty strings, take no part.

    Ids that repeat are judged as one: a pair is given once if any of its rows contains.
    """
    # split at ASCII white space only, on both sides, so that inner words are whole in the text too
    inner = F.split(string, r"[ \t\n\x0b\f\r]+")
    sought = strings.where((F.length(string) > 0) & F.col(string_id).isNotNull()).select(F.col(string_id).alias("s_id"), F.col(string).alias("s"), inner.alias("w"))
    sought = sought.withColumn("w", F.when(F.size("w") > 2, F.slice("w", 2, F.size("w") - 2)).otherwise(F.array().cast("array<string>")))
    sought = settled(sought.select("s_id", "s", "w", F.least(F.size("w"), F.lit(RUN)).alias("by_words"), F.least(F.length("s"), F.lit(SIGNS)).alias("by_signs")))
    kinds = {(r["by_words"] or -r["by_signs"]) for r in sought.select("by_words", "by_signs").distinct().collect()}  # at most RUN + SIGNS of them
    parts = None
    docs = texts.where(F.col(text).isNotNull() & F.col(text_id).isNotNull()).select(F.col(text_id).alias("t_id"), F.col(text).alias("t"))
    split = F.filter(F.split("t", r"[ \t\n\x0b\f\r]+"), lambda w: w != "")
    found = []
    for kind in sorted(kinds):
        mine = sought.where(F.col("by_words") == kind) if kind > 0 else sought.where((F.col("by_words") == 0) & (F.col("by_signs") == -kind))
        grams = settled(mine.select("s_id", "s", F.explode(_grams(F.col("w"), F.lit(kind)) if kind > 0 else _signs(F.col("s"), F.lit(-kind))).alias("g")))
        wanted = grams.select("g").distinct()
        wanted = wanted.hint("broadcast" if wanted.count() <= MAX_BROADCAST else "merge")
        every = docs.withColumn("words", split) if kind > 0 else docs
        listed = settled(every.select("t_id", F.explode(_grams(F.col("words"), F.lit(kind)) if kind > 0 else _signs(F.col("t"), F.lit(-kind))).alias("g")).join(wanted, "g", "left_semi"))
        often = settled(listed.groupBy("g").agg(F.count("*").alias("n")))
        # a string with a run that no text has is in none
        rarest = grams.join(often, "g", "left").groupBy("s_id", "s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("r")).where("r.n > 0")
        pairs = listed.join(rarest.select("s_id", "s", F.col("r.g").alias("g")), "g").select("t_id", "s_id", "s").distinct()
        found.append(docs.join(pairs, "t_id").where(F.col("t").contains(F.col("s"))).select("t_id", "s_id"))
    for f in found:
        parts = f if parts is None else parts.unionByName(f)
    if parts is None:
        parts = docs.join(sought.select("s_id"), F.lit(False)).select("t_id", "s_id")
    return parts.distinct().select(F.col("t_id").alias(text_id), F.col("s_id").alias(string_id))
