"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of two lexicons (a fixed list of insults, and words and stems of words that labelled
toxic texts have far more often than others), how near second-person words are to them, capitals, punctuation, and
how much of the text is spelt to deceive: digits and signs for letters, letters set apart or drawn out.
The trees are fitted in numpy on a bounded sample of labelled rows.  To calibrate, each quarter of the
sample is judged by trees that were fitted on the other quarters, and pooling adjacent violators turns
these sums into probabilities.

The learnt lexicon that a training row's features use comes from the other half of the sample, so that no
word is credited for its own label; near copies (equal smallest shingle hash) lie in one quarter and count once.

Edge cases: null and empty texts are scored as texts without words; labels of a repeated id are averaged,
null labels are ignored, labels of equal texts are averaged; without labelled rows of either kind every
score is the labelled share of toxic texts, or 0; ties of words and cuts go to the smaller; repeated rows are scored
alike; other columns may have any name.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm import textkit as tk
from recordloom.llm.store import settle
from recordloom.llm.textmap import add_columns

#: Labelled rows that are fitted on, half of them of each label where there are as many.
MAX_TRAIN = 4_096
#: Learnt words and stems at most, the texts that must have one, how much more often and how surely.
MAX_LEARNT, LEAST_TEXTS, LEAST_RATIO, LEAST_Z = 256, 3, 8.0, 2.8
TREES, DEPTH, RATE, BINS, SMOOTH = 60, 3, 0.15, 32, 4.0
#: Of a rating: words on either side that count as near, and the window of the densest passage.
NEAR, PASSAGE = 5, 50
#: Letters of a stem; a text counts for a stem that starts two of its words.
STEM_LETTERS = (5, 6, 7, 8)
# fixed values: insults, and words for the person spoken to, in four languages
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool foolish loser losers scum scumbag trash garbage worthless pathetic disgusting clown clowns jerk creep freak filth filthy vermin imbecile cretin "
    "halfwit dimwit nitwit bastard bitch asshole arsehole shit shitty bullshit crap fuck fucking fucker whore slut retard retarded pig swine coward liar lunatic psycho ugly useless hate die kill "
    "dumm blöd blöde idioten trottel depp vollidiot arschloch scheiße scheisse hurensohn drecksau wichser miststück abschaum versager widerlich erbärmlich "
    "imbécile crétin con connard connasse salaud salope merde putain ordure abruti débile minable dégoûtant raclure "
    "idiota imbécil estúpido estúpida tonto cabrón gilipollas mierda puta puto pendejo basura asqueroso patético inútil escoria"
).split()
SECOND_PERSON = "you your yours yourself yourselves u ur ya du dich dir dein deine deinen deiner euch euer ihr tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: letters, any character beyond ASCII among them.
WORD = r"[A-Za-z\x{80}-\x{10FFFF}]+"

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
#: What a byte stands for where spelling deceives; 0 for nothing.
STANDS = np.where(LETTER, tk.LOWER, 0).astype(np.uint8)
for _sign, _letter in zip("013457@$!|", "oieastasii", strict=True):
    STANDS[ord(_sign)] = ord(_letter)
EDGE = np.zeros(256, bool)
EDGE[[ord(c) for c in ".,;:!?'\"()[]{}<>*_-#%&"]] = True
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in "!?"]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True


def code_of(words: list[str]) -> np.ndarray:
    """Sorted codes of some words, as `word_codes` gives them."""
    data, at = tk.utf8(pa.array(words, pa.string()))
    return np.unique(tk.word_codes(data, at[:-1], at[1:], lower=True)) if words else np.zeros(0, tk.U)


def drawn_in(word: str) -> str:
    """A word without repeats of a letter."""
    return "".join(c for k, c in enumerate(word) if k == 0 or c != word[k - 1])


def member(codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(codes), bool)
    return of[np.minimum(np.searchsorted(of, codes), len(of) - 1)] == codes


class Lexicon:
    """Codes of the fixed insults and of learnt words, as written and without repeated letters, and of learnt stems by their bytes."""

    def __init__(self, learnt: list[str], stems: list[str]) -> None:
        self.fixed, self.learnt, self.second = code_of(INSULTS), code_of(learnt), code_of(SECOND_PERSON)
        self.stems = {n: code_of([s for s in stems if len(s.encode()) == n]) for n in sorted({len(s.encode()) for s in stems})}
        self.drawn = code_of([drawn_in(w) for w in [*INSULTS, *learnt] if len(drawn_in(w)) >= 4])


def plain_reading(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of whitespace words as read past deceit, their rows, starts and ends.

    Signs at a word's edges go, digits and signs become the letters they stand for, what stands for
    nothing goes, and a letter that is repeated counts once.
    """
    starts, ends, first = tk.words(data, at)
    row = tk.row_of(first)
    core = ~tk.WHITE[data] & ~EDGE[data]
    place = np.concatenate([[0], np.cumsum(core)])
    at_core = np.flatnonzero(core)
    some = place[ends] > place[starts]
    starts, ends, row = starts[some], ends[some], row[some]
    lo, hi = at_core[place[starts]], at_core[place[ends] - 1] + 1
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, lo, 1)
    np.add.at(inside, hi, -1)
    word = np.repeat(np.arange(len(lo)), hi - lo)
    spot = np.flatnonzero(np.cumsum(inside[:-1]))
    letter = STANDS[data[spot]]
    word, letter = word[letter > 0], letter[letter > 0]
    fresh = np.ones(len(letter), bool)
    fresh[1:] = (letter[1:] != letter[:-1]) | (word[1:] != word[:-1])
    word, letter = word[fresh], letter[fresh]
    begin = np.searchsorted(word, np.arange(len(lo) + 1))
    return tk.word_codes(letter, begin[:-1], begin[1:], lower=True), row, lo, hi


def features(data: np.ndarray, at: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """A row for each text."""
    n = len(at) - 1
    letter = LETTER[data]
    starts, ends, first = tk.spans(letter, at)
    row, count = tk.row_of(first), np.diff(first)
    code = tk.word_codes(data, starts, ends, lower=True)
    size = ends - starts
    many, chars = np.maximum(count, 1), np.maximum(np.diff(at), 1)
    by_row = lambda mask: np.bincount(row[mask], minlength=n)
    fixed, learnt, second = member(code, lexicon.fixed), member(code, lexicon.learnt), member(code, lexicon.second)
    begins, stem = tk.RangeHash(tk.BYTE_CODE_LOWER[data]), np.zeros(len(code), bool)
    for n_bytes, stems in lexicon.stems.items():
        long = np.flatnonzero(size >= n_bytes)
        stem[long] |= member(begins(starts[long], starts[long] + n_bytes), stems)
    hit = fixed | learnt | stem
    hits = by_row(hit)

    # how near the person spoken to is: other words between, at most
    to = np.flatnonzero(second)
    spots = np.flatnonzero(hit)
    near = np.zeros(len(spots), bool)
    if len(to):
        after = np.searchsorted(to, spots)
        for other in (to[np.minimum(after, len(to) - 1)], to[np.maximum(after - 1, 0)]):
            near |= (np.abs(other - spots) <= NEAR) & (row[other] == row[spots])
    densest = np.zeros(n)
    if len(spots):
        until = np.minimum(spots + PASSAGE, first[row[spots] + 1])
        np.maximum.at(densest, row[spots], np.searchsorted(spots, until) - np.arange(len(spots)))

    running = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at])
    letters = np.maximum(running(letter), 1)
    capital = np.concatenate([[0], np.cumsum(CAPITAL[data])])
    shouted = (capital[ends] - capital[starts] == size) & (size >= 3)
    same = np.zeros(len(data), bool)
    same[1:] = data[1:] == data[:-1]
    same[at[:-1][at[:-1] < len(data)]] = False
    twice = same.copy()
    twice[1:] &= same[:-1]
    drawn = np.concatenate([[0], np.cumsum(twice & letter)])
    marks = MARK[data]

    read, read_row, lo, hi = plain_reading(data, at)
    letters_so_far = np.concatenate([[0], np.cumsum(letter)])
    mixed = (letters_so_far[hi] - letters_so_far[lo] < hi - lo) & (letters_so_far[hi] > letters_so_far[lo])
    hit_so_far = np.zeros(len(data) + 1, np.int64)
    np.add.at(hit_so_far, starts[hit] + 1, 1)
    hit_so_far = np.cumsum(hit_so_far)
    hidden = member(read, lexicon.drawn) & (hit_so_far[hi] == hit_so_far[lo])
    words = np.maximum(np.bincount(read_row, minlength=n), 1)

    # letters set apart: runs of words of one letter, read as a word
    lone = size == 1
    lone_start, lone_end, _ = tk.spans(lone, first)
    runs = lone_end - lone_start >= 3
    squeezed = data[letter]
    spelt = tk.word_codes(squeezed, letters_so_far[starts[lone_start[runs]]], letters_so_far[ends[lone_end[runs] - 1]], lower=True) if runs.any() else np.zeros(0, tk.U)
    apart_row = row[lone_start[runs]] if runs.any() else np.zeros(0, np.int64)
    hidden_rows = np.bincount(read_row[hidden], minlength=n) + np.bincount(apart_row[member(spelt, lexicon.fixed) | member(spelt, lexicon.learnt)], minlength=n)

    return np.stack(
        [
            by_row(fixed) / many, np.log1p(by_row(fixed)), by_row(learnt) / many, np.log1p(by_row(learnt)), by_row(stem) / many, np.log1p(by_row(stem)), densest,
            hidden_rows / words, np.log1p(hidden_rows), by_row(second) / many, np.bincount(row[spots][near], minlength=n) / many, np.bincount(row[spots][near], minlength=n) / np.maximum(hits, 1),
            running(CAPITAL[data]) / letters, by_row(shouted) / many, by_row(shouted & hit) / many,
            running(data == 33) / chars, running(data == 63) / chars, running(marks & same) / chars, running(SYMBOL[data]) / chars,
            np.bincount(read_row[mixed], minlength=n) / words, by_row(drawn[ends] > drawn[starts]) / many, np.bincount(apart_row, minlength=n) / many,
            np.log1p(count), np.bincount(row, size, n) / many,
        ],
        1,
    )


class Trees:
    """Boosted trees of equal depth for the logarithm of odds, grown on weighted rows over binned features."""

    def __init__(self, base: float, cuts: np.ndarray, places: np.ndarray, leaves: np.ndarray) -> None:
        self.base, self.cuts, self.places, self.leaves = base, cuts, places, leaves

    @classmethod
    def grow(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> "Trees":
        w = w / w.mean()
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
        share = np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6)
        base = float(np.log(share / (1 - share)))
        total = np.full(len(y), base)
        inner = (1 << depth) - 1
        cuts, places, leaves = np.full((trees, inner), np.inf), np.zeros((trees, inner), np.int64), np.zeros((trees, inner + 1))
        least = max(2.0, 0.005 * len(y))
        for t in range(trees):
            p = 1 / (1 + np.exp(-total))
            g, h = w * (p - y), w * p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for k in range(inner):
                here = node == k
                best = (1e-6, 0, np.inf, 0)
                if here.sum() >= 2 * least:
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        sums = [np.cumsum(np.bincount(bins[here, f], v[here], len(e) + 1)) for v in (g, h, w)]
                        (gl, hl, wl), (gt, ht, wt) = [s[:-1] for s in sums], [s[-1] for s in sums]
                        gain = gl**2 / (hl + SMOOTH) + (gt - gl) ** 2 / (ht - hl + SMOOTH) - gt**2 / (ht + SMOOTH)
                        gain[(wl < least) | (wt - wl < least)] = 0
                        j = int(gain.argmax())
                        if gain[j] > best[0]:
                            best = (gain[j], f, e[j], j)
                _, f, cut, j = best
                cuts[t, k], places[t, k] = cut, f
                node[here] = 2 * k + 1 + (bins[here, f] > j if np.isfinite(cut) else 0)
            for k in range(inner + 1):
                here = node == inner + k
                leaves[t, k] = -RATE * g[here].sum() / (h[here].sum() + SMOOTH)
                total[here] += leaves[t, k]
        return cls(base, cuts, places, leaves)

    def sums(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for cut, place, leaf in zip(self.cuts, self.places, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(len(cut).bit_length()):
                node = 2 * node + 1 + (x[rows, place[node]] > cut[node])
            total += leaf[node - len(cut)]
        return total


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middles and means of the blocks of the best rising step function; equal x are one point."""
    at, of = np.unique(x, return_inverse=True)
    weight = np.bincount(of, w)
    blocks: list[list[float]] = []  # sum of y, weight, sum of x
    for a, b, c in zip(np.bincount(of, w * y), weight, at, strict=True):
        blocks.append([a, b, b * c])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class ToxicityModel:
    """Lexicon, trees and calibration; a few hundred words and some thousand numbers."""

    def __init__(self, lexicon: Lexicon, trees: Trees, at: np.ndarray, share: np.ndarray) -> None:
        self.lexicon, self.trees, self.at, self.share = lexicon, trees, at, share

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.sums(features(data, at, self.lexicon)), self.at, self.share), 0.0, 1.0)


def _group(data: np.ndarray, at: np.ndarray) -> list:
    """The smallest hash of a text's runs of three words, alike for most near copies."""
    starts, ends, first = tk.words(data, at)
    code, row = tk.shingle_codes(tk.word_codes(data, starts, ends, lower=True), first, 3)
    least = np.full(len(at) - 1, np.iinfo(tk.U).max)
    np.minimum.at(least, row, code)
    return [tk.signed(tk.mix(least))]


def sampled(docs: DataFrame, labels: DataFrame, limit: int) -> tuple[DataFrame, dict[int, int]]:
    """Rows (h, y, toxic, text, kin) of at most `limit` distinct labelled texts, and how many there are of each kind.

    Texts are drawn by hash, half of each kind where there are as many.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("y"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    marked = settle(texts.select("doc_id", "h").join(known, "doc_id").groupBy("h").agg(F.avg("y").alias("y"), F.min("doc_id").alias("doc_id")).withColumn("toxic", (F.col("y") >= 0.5).cast("int")))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    few = min(counts.values(), default=0) if len(counts) > 1 else 0
    share = min(limit // 2, few)
    take = {k: min(n, share if n == few else limit - share) for k, n in counts.items()}
    parts = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("h"), "h").limit(n) for k, n in sorted(take.items())]
    chosen = parts[0].unionByName(parts[-1]).distinct() if parts else marked
    rows = texts.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["h"])
    return settle(add_columns(rows, "text", ["h", "y", "toxic", "text"], {"kin": "long"}, _group)), counts


def units(sample: DataFrame) -> DataFrame:
    """(kin, toxic, half, kind, unit): the words of each group of near copies, and the stems that start two words of a text."""
    words = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"({WORD})"), 1)).alias("word")
    counted = sample.select("h", "kin", "toxic", "half", words).groupBy("h", "kin", "toxic", "half", "word").agg(F.count("*").alias("n"))
    stems = F.transform(F.filter(F.array(*[F.lit(k) for k in STEM_LETTERS]), lambda k: k <= F.length("word")), lambda k: F.struct(F.lit("stem").alias("kind"), F.substring(F.col("word"), F.lit(1), k).alias("unit")))
    each = F.explode(F.concat(F.array(F.struct(F.lit("word").alias("kind"), F.col("word").alias("unit"))), stems)).alias("u")
    found = counted.select("h", "kin", "toxic", "half", "n", each).groupBy("h", "kin", "toxic", "half", "u.kind", "u.unit").agg(F.sum("n").alias("n"))
    return found.where("kind = 'word' or n > 1").select("kin", "toxic", "half", "kind", "unit").distinct()


def learnt(found: DataFrame, sizes: dict[int, int], half: int | None) -> Lexicon:
    """Words and stems of toxic texts that others lack, from one half of the sample or from all of it."""
    mine = found if half is None else found.where(F.col("half") == half)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    ratio = (a / (sizes.get(1, 0) + 1)) / (b / (sizes.get(0, 0) + 1))
    counted = mine.groupBy("kind", "unit").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    sure = F.log(ratio) / F.sqrt(1 / a + 1 / b)
    picked = counted.where((F.col("a") >= LEAST_TEXTS) & (ratio >= LEAST_RATIO) & (sure >= LEAST_Z)).withColumn("sure", sure)
    best = [[r["unit"] for r in picked.where(F.col("kind") == kind).orderBy(F.desc("sure"), "unit").limit(MAX_LEARNT).select("unit").collect()] for kind in ("word", "stem")]
    return Lexicon(*best)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> ToxicityModel | float:
    """Fit on `labels` (doc_id, label 0 to 1); a number, where only one kind is labelled, is the score of all texts."""
    sample, counts = sampled(docs, labels, max_train)
    if len(counts) < 2:
        return float(next(iter(counts), 0))
    # groups of near copies are dealt into quarters; the first two are one half
    sample = sample.withColumn("quarter", F.pmod(F.xxhash64("kin"), F.lit(4)).cast("int")).withColumn("half", F.expr("quarter div 2"))
    once = sample.groupBy("kin", "toxic", "half").agg(F.count("*").alias("n"))
    groups = {(r["toxic"], r["half"]): r["count"] for r in once.groupBy("toxic", "half").count().collect()}
    found = settle(units(sample))
    size = lambda *halves: {k: sum(groups.get((k, h), 0) for h in halves) for k in (0, 1)}
    lexicons = [learnt(found, size(1), 1), learnt(found, size(0), 0)]
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)
    vector = lambda data, at: [[v.tobytes() for v in np.concatenate([features(data, at, lx) for lx in shared.value], 1)]]
    kin = Window.partitionBy("kin", "toxic")
    sample = sample.withColumn("weight", 1 / F.count("*").over(kin))
    got = add_columns(sample, "text", ["h", "y", "toxic", "quarter", "weight"], {"x": "binary"}, vector).orderBy("h").toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float64).reshape(len(got), len(lexicons), -1)
    quarter, y, toxic, w = (got[c].to_numpy(np.float64) for c in ("quarter", "y", "toxic", "weight"))
    x = x[np.arange(len(x)), quarter.astype(np.int64) // 2]
    for k, n in counts.items():  # kinds weigh as in all labelled texts
        w[toxic == k] *= n / max(w[toxic == k].sum(), 1e-9)
    sums = np.zeros(len(x))
    for q in range(4):
        mine = quarter == q
        if mine.any() and not mine.all():
            sums[mine] = Trees.grow(x[~mine], y[~mine], w[~mine]).sums(x[mine])
    return ToxicityModel(learnt(found, size(0, 1), None), Trees.grow(x, y, w), *isotonic(sums, y, w))


def score(docs: DataFrame, model: ToxicityModel | float, keep: list[str], out: str = "score") -> DataFrame:
    """`keep` columns and the score of every whole text."""
    if not isinstance(model, ToxicityModel):
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(model).alias(out))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, "text", keep, {out: "double"}, lambda data, at: [shared.value.score(data, at)])


def held_out(doc_id: str = "doc_id"):
    """Rows that labels are not learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_digest(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = docs.select("doc_id", "text")
    model = train(rows, labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label")), **options)
    return score(rows, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
