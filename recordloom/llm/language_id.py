"""Language ID: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

A text is the average of the embeddings of all its byte 3-grams and 4-grams, hashed to buckets;
embeddings and softmax are trained together by stochastic gradient descent in numpy.  The model is
linear once trained, so that a text's logits are the mean of one small row for each of its n-grams.

Edge cases: a null text, or one without a letter, is `und` with score 0; a text too short for any
n-gram gets the prior; without a labelled row everything is `und`; repeated rows and ties are scored
alike (ties go to the first language by name); other columns may have any name.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm import textkit as tk
from recordloom.llm.store import unused
from recordloom.llm.textmap import add_columns

BUCKETS = 1 << 14
DIM = 16
#: Labelled rows to fit on, over all languages; the rest of the labelled rows is not needed.
MAX_TRAIN = 2048
FLAT = np.where(tk.WHITE, 32, tk.LOWER).astype(np.uint32)


def ngrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each 3-gram and 4-gram that stays in a row, and its row; rows ascend in each half."""
    b = FLAT[data]
    row = tk.row_of(at)
    buckets, rows = [], []
    for n in (3, 4):
        if len(b) < n:
            continue
        code = np.full(len(b) - n + 1, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) ^ b[k : len(b) - n + 1 + k]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(18)
        whole = row[: len(code)] == row[n - 1 :]
        buckets.append(code[whole].astype(np.int32))
        rows.append(row[: len(code)][whole])
    return (np.concatenate(buckets), np.concatenate(rows)) if buckets else (np.zeros(0, np.int32), np.zeros(0, np.int64))


class LanguageModel:
    """Trained tables: one logit row a bucket, biases, temperature and the rejection threshold."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float) -> None:
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table, bias, temperature, threshold

    def probabilities(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        bucket, row = ngrams(data, at)
        n = np.bincount(row, minlength=len(at) - 1)
        logits = np.stack([np.bincount(row, self.table[:, k][bucket], len(at) - 1) for k in range(len(self.languages))], 1) / np.maximum(n, 1)[:, None] + self.bias
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sample(docs: DataFrame, label: str, limit: int) -> DataFrame:
    """(id, lang, text): about `limit` labelled texts by hash, as even over labels as their counts allow; never over twice as many.

    Equal texts of a label count once, and the first of each label by hash is always taken.  Only hashes
    are ranked; the texts that they name are then looked up where they are.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.col(label).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    once = rows.groupBy("lang", "h").agg(F.min("id").alias("id")).withColumn("draw", F.xxhash64("h", "lang"))
    share = F.pmod("draw", F.lit(1 << 30)) / float(1 << 30)
    once = once.withColumn("draw", share)
    counts = once.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.struct("draw", "h")).alias("first"))
    each = F.lit(float(limit)) / F.count("*").over(Window.partitionBy())
    counts = F.broadcast(counts.select("lang", (each / F.col("n")).alias("share"), F.col("first.h").alias("first")).orderBy("first").limit(limit))
    drawn = once.join(counts, "lang").where((F.col("draw") < F.col("share")) | (F.col("h") == F.col("first")))
    chosen = drawn.orderBy(F.col("h") != F.col("first"), "draw", "lang", "h").limit(2 * limit).select("lang", "h", F.col("id").alias("of"))
    return rows.join(F.broadcast(chosen), ["lang", "h"]).where(F.col("id").eqNullSafe(F.col("of"))).dropDuplicates(["lang", "h"]).select("id", "lang", "text")


def train(docs: DataFrame, label: str = "lang", max_train: int = MAX_TRAIN, epochs: int = 6, rate: float = 2.0, seed: int = 7) -> LanguageModel | None:
    """Fit on a bounded sample of the labelled rows of `docs`; a fifth of it calibrates the scores.

    The temperature is the one with the least log loss on the calibration rows; rejection keeps 99%
    of the rows that are rightly recognised there.
    """

    def sparse(data: np.ndarray, at: np.ndarray) -> list:
        bucket, row = ngrams(data, at)
        out = []
        for r in range(len(at) - 1):
            ids, n = np.unique(bucket[row == r], return_counts=True)
            out.append(ids.astype(np.uint16).tobytes() + n.astype(np.uint32).tobytes())
        return [out]

    got = add_columns(_sample(docs, label, max_train), "text", ["id", "lang"], {"x": "binary"}, sparse).toPandas().sort_values(["id", "lang", "x"])
    if got.empty:
        return None
    languages = sorted(got["lang"].unique(), key=lambda s: s.encode())
    y = np.array([languages.index(v) for v in got["lang"]])
    rows = []
    for x in got["x"]:
        n = len(x) // 6
        c = np.frombuffer(x[2 * n :], np.uint32).astype(np.float32)
        rows.append((np.frombuffer(x[: 2 * n], np.uint16), c / max(1.0, c.sum())))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = np.zeros(len(y), bool)
    held[order[: len(y) // 5]] = True
    held[[order[np.flatnonzero(y[order] == k)[-1]] for k in range(len(languages))]] = False  # one text of each is always learnt from
    check, fit = order[held[order]], order[~held[order]]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    step, steps = 0, epochs * len(fit)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, share = rows[i]
            lr = rate * (1 - step / steps)
            step += 1
            h = share @ emb[ids]
            z = h @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = w @ p
            w -= lr * np.outer(h, p)
            bias -= 0.01 * lr * p
            emb[ids] -= (lr * 40 * share)[:, None] * back
    table = emb @ w
    at = check if len(check) else fit
    logits = np.stack([rows[i][1] @ table[rows[i][0]] + bias for i in at])
    sure = 1 - 1 / (len(at) + 2)  # a sample without errors doesn't prove that there are none

    def loss(t: float) -> float:
        right = np.clip(softmax(logits / t)[np.arange(len(at)), y[at]], 1e-12, 1 - 1e-12)
        return -(sure * np.log(right) + (1 - sure) * np.log(1 - right)).mean()

    temperature = min((2.0**k for k in np.arange(-6, 4.5, 0.25)), key=loss)
    p = softmax(logits / temperature)
    right = p.max(1)[p.argmax(1) == y[at]]
    return LanguageModel(languages, table, bias, temperature, float(np.quantile(right, 0.01)) if len(right) else 0.0)


def predict(docs: DataFrame, model: LanguageModel | None, keep: list[str]) -> DataFrame:
    """`keep` columns with lang_pred, score and rejected for every whole text."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    has, lang, score = unused(docs, "has_letters", "lang_found", "score_found")
    rows = docs.withColumn(has, letters)
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(data: np.ndarray, at: np.ndarray) -> list:
        m = shared.value
        p = m.probabilities(data, at)
        return [np.array(m.languages, object)[p.argmax(1)], p.max(1).astype(np.float64)]

    done = add_columns(rows, "text", [*keep, has], {lang: "string", score: "double"}, run)
    found: Column = F.col(has)
    return done.select(
        *keep,
        F.when(found, F.col(lang)).otherwise("und").alias("lang_pred"),
        F.when(found, F.col(score)).otherwise(0.0).alias("score"),
        (~found | (F.col(score) < model.threshold)).alias("rejected"),
    )


def language_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and rejected); learns from rows that are not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    return predict(rows, train(rows.where("not held_out"), **options), ["doc_id", "held_out"])
