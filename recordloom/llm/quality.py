"""Quality classifier: votes of the nearest labelled texts in a latent space.

Each text becomes a vector of hashed words, hashed word shapes and a few text statistics; a singular
value decomposition of a bounded sample of labelled rows gives the latent space.  The labelled
latent vectors are broadcast, every document is compared with all of them by blocked cosine
products, and the labels of its nearest ones are weighted by similarity.

Edge cases: null and empty texts are scored as texts without words; labels of a repeated id are
averaged, null labels are ignored; ties of similarity go to the sample's order; without labelled
rows every score is 0.5; repeated rows are scored alike; other columns may have any name.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import textkit as tk
from recordloom.llm.textmap import add_columns

WORDS, SHAPES, LATENT, NEIGHBOURS = 512, 256, 32, 15
#: Labelled rows that are fitted on and broadcast: 2,500 * LATENT floats, 320 kB.
MAX_TRAIN = 2500
STATS = 14
# classes of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 symbol, 6 beyond ASCII
CLASS = np.zeros(256, np.uint8)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 6
CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 5


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each text: shares of hashed words and shapes, each of unit length, then statistics."""
    n = len(at) - 1
    starts, ends, first = tk.words(data, at)
    count = np.diff(first)
    row = tk.row_of(first)
    code = tk.word_codes(data, starts, ends, lower=True)
    kind = CLASS[data]
    # a shape: the classes of the first and the last three bytes, and the length up to 8
    size = ends - starts
    last = ends - 1
    pick = lambda p: kind[np.clip(p, starts, last)].astype(np.int64)
    shape = pick(starts)
    for p in (starts + 1, last - 2, last - 1, last):
        shape = shape * 7 + pick(p)
    shape = shape * 3 + np.digitize(size, (4, 12))
    out = np.zeros((n, WORDS + SHAPES + STATS))
    words = np.bincount(row * WORDS + (code % tk.U(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
    shapes = np.bincount(row * SHAPES + (tk.mix(shape) % tk.U(SHAPES)).astype(np.int64), minlength=n * SHAPES).reshape(n, SHAPES)
    for at_column, block in ((0, words), (WORDS, shapes)):
        block = np.sqrt(block)
        out[:, at_column : at_column + block.shape[1]] = block / np.maximum(np.sqrt((block**2).sum(1, keepdims=True)), 1)
    size_bytes = np.maximum(np.diff(at), 1)
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at]) / size_bytes
    many = np.maximum(count, 1)
    same = lambda x: np.bincount(row, x, n) / many
    repeat = np.zeros(len(code), bool)
    if len(code) > 1:
        repeat[1:] = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
    # how many words are the first of their kind in the text, relative to its length
    order = np.lexsort((code, row))
    new = np.ones(len(code), bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order], new, n)
    pair, pair_row = tk.shingle_codes(code, first, 3)
    order = np.lexsort((pair, pair_row))
    newp = np.ones(len(pair), bool)
    newp[1:] = (pair[order][1:] != pair[order][:-1]) | (pair_row[order][1:] != pair_row[order][:-1])
    triples = np.maximum(np.bincount(pair_row, minlength=n), 1)
    stats = [
        share(kind == 2), share(kind == 3), share(kind == 4), share(kind == 5), share(kind == 6), share(tk.WHITE[data]),
        same(repeat), distinct / many**0.75, np.bincount(pair_row[order], newp, n) / triples,
        same(size) / 10, np.sqrt(np.maximum(same(size.astype(float) ** 2) - same(size) ** 2, 0)) / 10,
        same(size == 1), np.log1p(count) / 10, share(data == 10) * 10,
    ]
    out[:, WORDS + SHAPES :] = np.stack(stats, 1)
    return out


class QualityModel:
    """The latent projection, and the labelled vectors in it."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        self.mean, self.scale, self.axes, self.vectors, self.labels = mean, scale, axes, vectors, labels

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (((x - self.mean) * self.scale) @ self.axes).astype(np.float32)
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        out = np.empty(len(x))
        z = self.latent(x)
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(x), 256):
            near = z[i : i + 256] @ self.vectors.T
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(near, best, 1).astype(np.float64), 1e-6) ** 4
            out[i : i + 256] = (weight * self.labels[best]).sum(1) / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> QualityModel | None:
    """Fit on `labels` (doc_id, label 0 to 1), the first `max_train` labelled ids by hash."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    vector = lambda data, at: [[v.tobytes() for v in features(data, at).astype(np.float32)]]
    got = add_columns(rows, "text", ["doc_id", "label"], {"x": "binary"}, vector).orderBy("doc_id").limit(2 * max_train).toPandas()
    if got.empty:
        return None
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1).astype(np.float64)
    y = got["label"].to_numpy(np.float64)
    mean = x.mean(0)
    # blocks count alike: words and shapes as they are, statistics in standard deviations
    scale = np.ones(x.shape[1])
    scale[WORDS + SHAPES :] = 0.25 / np.maximum(x[:, WORDS + SHAPES :].std(0), 1e-3)
    z = (x - mean) * scale
    _, axes = np.linalg.eigh(z.T @ z)
    model = QualityModel(mean, scale, axes[:, ::-1][:, :LATENT], np.zeros((0, LATENT), np.float32), y)
    model.vectors = model.latent(x)
    return model


def score(docs: DataFrame, model: QualityModel | None, keep: list[str], out: str = "score") -> DataFrame:
    """`keep` columns and the score of every whole text."""
    if model is None:
        return docs.select(*keep, F.lit(0.5).alias(out))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, "text", keep, {out: "double"}, lambda data, at: [shared.value.score(features(data, at))])


def learnable(doc_id: str = "doc_id"):
    """Rows that labels are learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def quality_digest(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels.where(learnable()).select("doc_id", F.col("quality").alias("label")), **options)
    done = score(docs.select("doc_id", "text"), model, ["doc_id"])
    return done.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
