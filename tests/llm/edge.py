"""Small tables with every awkward row."""

import random

from pyspark.sql import functions as F

#: Columns that clash with names which operators use inside.
EXTRA = ["score", "size", "row", "h1", "node", "component", "gram", "spans", "value", "n", "id", "item_id", "taken", "held_out", "label", "__hit", "hit", "__score", "__redacted", "redacted", "__h", "h", "k", "__text", "__letters", "__label", "__share", "__lang", "__key"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edge_rows(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    base, passage = words(r, 300), words(r, 60)
    near = base.split()
    near[7] = "changed"
    texts = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two three"), (5, "one TWO three"), (6, "a b c d e"), (7, base), (8, base), (9, " ".join(near)), (10, words(r, 6000)), (11, words(r, 80) + " " + passage + " " + words(r, 70)),
        (12, words(r, 30) + "\n" + passage + "\t" + words(r, 90)), (13, "Orre " * 400), (14, "é" * 500), (15, "日本語 のテキスト " * 60), (16, passage), (None, base), (17, "x"), (18, words(r, 25)), (18, words(r, 25)), (19, base.upper()),
    ]
    return [(k, t, ["en", None, "de"][i % 3], ["s1", None, "s2", "\U0001f600"][i % 4], None if t is None else len(t)) for i, (k, t) in enumerate(texts)]


def edge_docs(spark, seed: int = 1):
    df = spark.createDataFrame(edge_rows(seed), SCHEMA)
    return df.withColumns({c: F.lit(1) for c in EXTRA})


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
