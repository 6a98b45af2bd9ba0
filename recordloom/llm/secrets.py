"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

The field tags every token of every text as secret begin (B), inside (I) or outside (O), and is
decoded by Viterbi.  Its features are flags of the token's shape and of the text, and hashed identities
that it learns weights for: the token's word, those of its neighbours, the shapes of all three as
strings of character classes, and pairs of them.  It is trained here, on lines of the corpus with
base matches, with planted secrets in many forms and with planted decoys (hosts, addresses, versions,
dates, paths, codes) that are no secrets.

Edge cases: a null text is an empty text, without spans; offsets are code points of the whole text;
repeated rows get equal spans; without texts to learn from only base spans are found; an empty table
gives an empty result; other columns may have any name.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import textkit as tk
from recordloom.llm.store import arrow_rows, unused

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
KEY_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "credential", "credentials", "bearer", "auth", "authorization", "key", "pwd", "passphrase", "private", "pass", "access")
MAX_TRAIN = 600
N_FLAGS, N_HASHED, BUCKETS = 35, 10, 1 << 14
MINED = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, leftmost and non-overlapping for each kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if MINED.search(text) else []
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16] if "AKIA" in text else []
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---- tokens and features -------------------------------------------------------------------
# a token is a run of the characters that secrets are written with; any other visible byte is one by itself
_CORE = np.zeros(256, bool)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-":
    _CORE[_c] = True
_CORE[128:] = True
_DIGIT, _UPPER, _LOWER, _HEXCH = (np.zeros(256, bool) for _ in range(4))
_DIGIT[48:58] = _UPPER[65:91] = _LOWER[97:123] = True
_HEXCH[48:58] = _HEXCH[97:103] = True
_JOIN = np.zeros(256, bool)
_JOIN[[ord(c) for c in "+/_.-"]] = True
_VOWEL, _DOT = np.zeros(256, bool), np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
_DOT[ord(".")] = True


def _word_hash(words: tuple[str, ...]) -> np.ndarray:
    data, at = tk.utf8(pa.array([w.replace("_", "") for w in words]))
    return np.unique(tk.RangeHash(tk.BYTE_CODE_LOWER[data])(at[:-1], at[1:]))


_KEYS = _word_hash(KEY_WORDS)


def tokenize(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and each row's first token."""
    core = _CORE[data]
    starts, ends, _ = tk.spans(core, at)
    single = np.flatnonzero(~core & ~tk.WHITE[data])
    order = np.argsort(np.concatenate([starts, single]), kind="stable")
    starts, ends = np.concatenate([starts, single])[order], np.concatenate([ends, single + 1])[order]
    return starts, ends, np.searchsorted(starts, at)


def token_features(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every token: flags of its own shape, its neighbours and the text, and buckets of hashed words and shapes."""
    n = len(starts)
    flags, hashed = np.zeros((n, N_FLAGS), np.float32), np.zeros((n, N_HASHED), np.int32)
    if not n:
        return flags, hashed
    size = ends - starts
    total = lambda mask: (c := np.concatenate([[0], np.cumsum(mask, dtype=np.int32)]))[ends] - c[starts]
    digits, upper, lower, hexes, joins, vowels, dots = (total(m[data]) for m in (_DIGIT, _UPPER, _LOWER, _HEXCH, _JOIN, _VOWEL, _DOT))
    kind = _DIGIT[data] * 1 + _UPPER[data] * 2 + _LOWER[data] * 4
    after = np.zeros(len(data), bool)  # whether a byte follows one of the same token
    after[1:] = True
    after[starts] = False
    before = np.concatenate([[0], kind[:-1]])
    change = after & (kind != before)
    changes, turns, rises = total(change), total(change & (kind > 0) & (before > 0) & ((kind == 1) | (before == 1))), total(change & (before == 4) & (kind == 2))
    # how long the run of one class is up to each byte, and each token's longest
    here = np.arange(len(data))
    upto = here - np.maximum.accumulate(np.where(change | ~after, here, 0)) + 1
    longest = np.maximum.reduceat(upto, starts) if n else upto
    letters = upper + lower
    mixed = (digits > 0) & (letters > 0)
    row = tk.row_of(first)
    word = tk.RangeHash(tk.BYTE_CODE_LOWER[data])(starts, ends)
    key = np.isin(word, _KEYS)
    one = data[starts]
    mark = (size == 1) & ((one == ord("=")) | (one == ord(":")))
    quote = (size == 1) & ((one == ord('"')) | (one == ord("'")))
    place = np.arange(n)

    def near(x: np.ndarray, k: int) -> np.ndarray:
        """The value of the k-th token after each one in its text, or zero."""
        to = np.clip(place + k, 0, n - 1)
        return np.where((place + k >= first[row]) & (place + k < first[row + 1]), x[to], x.dtype.type(0))

    prev = lambda x, k: near(x, -k)
    assigned = prev(mark, 1) | (prev(mark, 2) & prev(quote, 1))
    named = (prev(key, 1) | prev(key, 2) | prev(key, 3) | prev(key, 4)) & (prev(mark, 1) | prev(mark, 2) | prev(mark, 3))
    text_keys = np.bincount(row, key, len(at) - 1) > 0
    text_marks = np.bincount(row, mark, len(at) - 1) > 0
    columns = [
        np.ones(n, bool), size < 4, size >= 8, size >= 16, size >= 24, size >= 32,
        mixed, digits >= 3, mixed & (changes >= 4), mixed & (changes >= 8), (hexes == size) & (size >= 16), (upper > 0) & (lower > 0) & (digits > 0),
        (upper > 2) & (digits > 0) & (lower == 0), joins > 0, digits == size, letters == size,
        assigned, named, assigned & mixed & (size >= 8), named & mixed & (size >= 8), prev(key, 1), mark | quote,
        text_keys[row] & mixed & (size >= 8), text_marks[row] & mixed & (size >= 12),
        (dots > 0) & (upper == 0), longest >= 6, (longest >= 5) & (lower >= 5) & (turns <= 2), turns >= 3, turns >= 6, rises >= 3,
        (size >= 12) & (digits >= 2) & (letters >= 4) & (longest <= 4), (vowels >= 0.25 * letters) & (letters >= 4), size >= 2.5 * (changes + 1), size >= 4 * (changes + 1), (lower >= 0.6 * size) & (vowels >= 0.25 * lower),
    ]
    for k, c in enumerate(columns):
        flags[:, k] = c
    # a shape: classes of the first and last three bytes, classes that occur, and steps of length, changes and longest run
    last = ends - 1
    at_byte = lambda p: kind[np.clip(p, starts, last)].astype(np.int64)
    shape = at_byte(starts)
    for p in (starts + 1, starts + 2, last - 2, last - 1, last):
        shape = shape * 5 + at_byte(p)
    grams = np.minimum(turns, 7) * 64 + np.minimum(rises, 7) * 8 + np.minimum(joins, 7)
    steps = (np.digitize(size, (2, 4, 8, 12, 16, 24, 32)) * 8 + np.digitize(longest, (2, 3, 4, 5, 6, 8, 12))) * 8 + (digits > 0) * 1 + (upper > 0) * 2 + (lower > 0) * 4
    shape, grams, steps = (x.astype(tk.U) for x in (tk.mix(shape * 4096 + steps), grams, steps))
    word = np.where(mixed & (size >= 8), tk.U(1), word)  # a value that looks random is no word
    parts = [word, prev(word, 1), prev(word, 2), prev(word, 3), near(word, 1), shape, prev(steps, 1), near(steps, 1), tk.mix(grams * tk.U(4096) + steps), tk.mix(prev(word, 1) ^ tk.mix(steps))]
    for k, c in enumerate(parts):
        hashed[:, k] = tk.mix(c + tk.U(k)) % tk.U(BUCKETS)
    return flags, hashed


# ---- the field -----------------------------------------------------------------------------
B, I, O = 0, 1, 2  # noqa: E741


class Field:
    """Weights of a chain over B, I, O: of flags and of buckets, one column a tag, of transitions, and of starts."""

    def __init__(self, weights: np.ndarray, table: np.ndarray, moves: np.ndarray, start: np.ndarray) -> None:
        self.weights, self.table, self.moves, self.start = weights, table, moves, start

    def scores(self, flags: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        out = flags @ self.weights
        for k in range(N_HASHED):
            out += self.table[hashed[:, k]]
        return out

    def tags(self, flags: np.ndarray, hashed: np.ndarray, first: np.ndarray, lanes: int = 512) -> np.ndarray:
        """The best path of every row, by Viterbi over `lanes` pieces of the chain at a time.

        Each piece is solved for each of the three tags before it, the pieces are then joined in
        order, and the path is read back.  A row's first token doesn't depend on the tag before it.
        """
        n = len(flags)
        if not n:
            return np.zeros(0, np.int8)
        steps = -(-n // lanes)
        score = np.full((lanes * steps, 3), -1e9)
        score[n:, O] = 0
        score[:n] = self.scores(flags, hashed)
        score = score.reshape(lanes, steps, 3)
        begin = np.ones(lanes * steps, bool)
        begin[:n] = False
        begin[first[:-1][np.diff(first) > 0]] = True
        begin = begin.reshape(lanes, steps)
        # axes: tag before the piece, tag now, lane
        best = np.where(np.eye(3, dtype=bool), 0.0, -1e15)[:, :, None].repeat(lanes, 2)
        back = np.empty((steps, 3, 3, lanes), np.int8)
        for t in range(steps):
            moves = np.where(begin[:, t], self.start[None, :, None], self.moves[:, :, None])
            reach = best[:, :, None] + moves
            most = np.maximum(reach[:, 0], reach[:, 1])
            last = reach[:, 2] > most
            np.copyto(back[t], reach[:, 1] > reach[:, 0])
            back[t][last] = 2
            best = np.maximum(most, reach[:, 2]) + score[:, t].T
        ahead, came = np.zeros(3), np.empty((lanes, 3), np.int8)
        for k in range(lanes):
            reach = ahead[:, None] + best[:, :, k]
            came[k] = reach.argmax(0)
            ahead = reach.max(0)
        state = np.empty(lanes, np.int64)
        entry = np.empty(lanes, np.int64)
        at = int(ahead.argmax())
        for k in range(lanes - 1, -1, -1):
            state[k], at = at, int(came[k, at])
            entry[k] = at
        out = np.empty((lanes, steps), np.int8)
        lane = np.arange(lanes)
        for t in range(steps - 1, -1, -1):
            out[:, t] = state
            state = back[t][entry, state, lane]
        return out.reshape(-1)[:n]


def _marginals(score: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a chain: each token's probability of each tag, and the expected number of moves from tag to tag.

    Forward and backward sums are scaled to one at each token; three plain floats are faster here than small arrays.
    """
    n = len(score)
    e = np.exp(np.maximum(score - score.max(1, keepdims=True), -300.0))
    m = np.exp(moves)
    (m00, m01, m02), (m10, m11, m12), (m20, m21, m22) = m.tolist()
    rows = e.tolist()
    a, b, c = (np.exp(start) * e[0]).tolist()
    z = a + b + c
    a, b, c = a / z, b / z, c / z
    ahead = [(a, b, c)]
    for p, q, r in rows[1:]:
        a, b, c = (a * m00 + b * m10 + c * m20) * p, (a * m01 + b * m11 + c * m21) * q, (a * m02 + b * m12 + c * m22) * r
        z = a + b + c
        a, b, c = a / z, b / z, c / z
        ahead.append((a, b, c))
    a, b, c = 1.0, 1.0, 1.0
    behind = [(a, b, c)]
    for p, q, r in rows[:0:-1]:
        a, b, c = a * p, b * q, c * r
        a, b, c = m00 * a + m01 * b + m02 * c, m10 * a + m11 * b + m12 * c, m20 * a + m21 * b + m22 * c
        z = a + b + c
        a, b, c = a / z, b / z, c / z
        behind.append((a, b, c))
    alpha, beta = np.array(ahead), np.array(behind[::-1])
    tags = alpha * beta
    tags /= tags.sum(1, keepdims=True)
    moved = alpha[:-1, :, None] * m * (e[1:] * beta[1:])[:, None, :]
    return tags, (moved / moved.sum((1, 2), keepdims=True)).sum(0) if n > 1 else np.zeros((3, 3))


def train_field(sequences: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 2.0, decay: float = 1e-4, seed: int = 11) -> Field:
    """Maximise the likelihood of tagged sequences (flags, buckets, tags) by stochastic gradient ascent."""
    rng = np.random.default_rng(seed)
    w, table, moves, start = np.zeros((N_FLAGS, 3)), np.zeros((BUCKETS, 3)), np.zeros((3, 3)), np.zeros(3)
    moves[O, I] = start[I] = -1e4  # inside follows begin or inside only
    free, free_start = moves == 0, start == 0
    field = Field(w, table, moves, start)
    step, steps = 0, epochs * max(1, len(sequences))
    for _ in range(epochs):
        for k in rng.permutation(len(sequences)):
            x, ids, y = sequences[k]
            score = field.scores(x, ids)
            n = len(x)
            p, pairs = _marginals(score, moves, start)
            g = -p
            g[np.arange(n), y] += 1
            lr = rate * (1 - step / steps) / np.sqrt(n)
            step += 1
            pair = -pairs
            np.add.at(pair, (y[:-1], y[1:]), 1)
            w += lr * (x.T @ g) - lr * decay * w
            np.add.at(table, ids.reshape(-1), np.repeat(0.3 * lr * g, N_HASHED, axis=0))
            moves += np.where(free, lr * pair, 0)
            start += np.where(free_start, lr * g[0], 0)
    return field


def _value(rng: np.random.Generator) -> str:
    """A random value as secrets have."""
    letters, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabet = str(rng.choice([digits + "abcdef", letters + digits, letters[:26] + digits, letters + digits + "+/_-"]))
    value = "".join(rng.choice(list(alphabet), int(rng.integers(12, 49))))
    if not any(c in digits for c in value) or not any(c in letters for c in value):
        value += "a7"
    return str(rng.choice(["", "", "ghp_", "sk-", "xoxb-", "AKIA"])) + value


def _decoy(rng: np.random.Generator) -> str:
    """What looks random and is no secret: hosts, addresses, versions, times, paths, codes, names of words and numbers."""
    word = lambda: "".join(c + v for c, v in zip(rng.choice(list("bcdfglmnprst"), 3), rng.choice(list("aeiou"), 3), strict=True))
    n = lambda k: "".join(rng.choice(list("0123456789"), k))
    code = "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZ"), 3))
    host = f"{word()}{n(1)}.{word()}.{rng.choice(['com', 'org', 'net', 'io'])}"
    piece = lambda: str(rng.choice([word(), word().capitalize(), word() + word(), n(int(rng.integers(1, 5)))]))
    composed = str(rng.choice(["", "", "-", "_", ".", "/"])).join(piece() for _ in range(int(rng.integers(2, 6))))
    if rng.random() < 0.3:
        return composed
    forms = [
        host, f"{word()}.{word()}@{host}", f"https://{host}/{word()}/{word()}-{n(4)}.html", ".".join(str(x) for x in rng.integers(0, 256, 4)), f"{n(1)}.{n(2)}.{n(1)}-{word()}{n(1)}",
        f"20{n(2)}-0{n(1)}-1{n(1)}", f"20{n(2)}-0{n(1)}-1{n(1)}T1{n(1)}:{n(2)}:{n(2)}Z", f"+{n(2)} {n(3)} {n(7)}", f"/usr/{word()}/{word()}{n(2)}/{word()}.conf", f"{code}-{n(5)}", f"{code}{n(6)}", n(10), n(16),
        word() + word().capitalize() + word().capitalize() + n(2), f"{word()}_{word()}_{n(2)}", f"{word()}-{word()}-{word()}-{n(3)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", (word() + word() + word()).capitalize(), f"{word()}{n(3)}@{host}", f"#{n(6)}",
    ]
    return str(rng.choice(forms))


def _plant(line: str, rng: np.random.Generator) -> tuple[str, int, int]:
    """A line with a secret in one of several forms between two of its words: text, start, end of the value."""
    value = _value(rng)
    lead = str(rng.choice(['token = "', 'secret: "', "password=", "api_key = '", "Authorization: Bearer ", "credentials: ", "pwd = ", "access key ", "", ""]))
    close = {'"': '"', "'": "'"}.get(lead[-1:], "")
    words = line.split(" ")
    at = int(rng.integers(0, len(words) + 1))
    before = "".join(w + " " for w in words[:at]) + lead
    return before + value + close + "".join(" " + w for w in words[at:]), len(before), len(before) + len(value)


def _with_decoys(line: str, rng: np.random.Generator) -> str:
    words = line.split(" ")
    for _ in range(int(rng.integers(1, 6))):
        words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(["", "", "", "id=", "key: ", "version ", "see ", "token ", "user: "])) + _decoy(rng))
    return " ".join(words)


def sequence(text: str, found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Flags, buckets and tags of a line whose secrets stand at `found` (code points); None without tokens."""
    data, at = tk.utf8(pa.array([text]))
    starts, ends, first = tokenize(data, at)
    if not len(starts):
        return None
    to_byte = np.cumsum([0] + [len(c.encode()) for c in text])
    y = np.full(len(starts), O)
    for s, e in found:
        inside = np.flatnonzero((starts >= to_byte[s]) & (ends <= to_byte[e]) & (ends - starts >= 8))
        y[inside] = I
        y[inside[:1]] = B
    flags, hashed = token_features(data, at, starts, ends, first)
    return flags.astype(np.float64), hashed, y


def train(docs: DataFrame, max_train: int = MAX_TRAIN, seed: int = 5) -> Field | None:
    """Fit on lines of a bounded sample of texts, the first `max_train` by hash of the id; one in two gets a planted secret, all decoys.

    A line of 400 characters is cut around the text's first digit, if there is one, so that numbers of all kinds are
    among the tokens outside.  Lines with a base match teach its value as a secret.
    """
    draw = F.xxhash64("doc_id")
    last = docs.where("text is not null").select(draw.alias("h")).orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    if last is None:
        return None
    line = F.substring("text", F.greatest(F.regexp_instr("text", F.lit("[0-9]")) - 150, F.lit(1)), F.lit(400))
    rows = docs.where("text is not null").where(draw <= last).select(draw.alias("h"), line.alias("line")).orderBy("h", "line").limit(max_train).collect()
    lines = [r["line"] for r in rows if r["line"]]
    if not lines:
        return None
    rng = np.random.default_rng(seed)
    sequences = []
    for k, text in enumerate(lines):
        found = [(s, e) for _, s, e in base_spans(text)]
        if not found:
            text = _with_decoys(text, rng)
            if k % 2:
                text, s, e = _plant(text, rng)
                found = [(s, e)]
        sequences.append(sequence(text, found))
    return train_field([s for s in sequences if s])


def scan_batch(data: np.ndarray, at: np.ndarray, field: Field | None) -> list[list[tuple[str, int, int]]]:
    """All spans of each row in code points, by start, then kind: base spans, then those the field adds outside them."""
    found: list[list[tuple[int, int]]] = [[] for _ in range(len(at) - 1)]
    if field is not None:
        starts, ends, first = tokenize(data, at)
        tags = field.tags(*token_features(data, at, starts, ends, first), first)
        hot = np.flatnonzero(tags != O)
        row = np.searchsorted(first, hot, "right") - 1
        for k, r in zip(hot.tolist(), row.tolist(), strict=True):
            s, e = int(starts[k]), int(ends[k])
            if tags[k] == I and found[r] and found[r][-1][2] == k - 1:
                found[r][-1] = (found[r][-1][0], e, k)
            else:
                found[r].append((s, e, k))
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if any(found) else at
    out = []
    for r in range(len(at) - 1):
        spans = base_spans(data[at[r] : at[r + 1]].tobytes().decode())
        if found[r]:
            s, e = (point[np.array(x)] - point[at[r]] for x in list(zip(*found[r], strict=True))[:2])
            if spans:  # base spans before each added one's end, and how far they reach
                begins, reach = np.array([x for _, x, _ in spans]), np.maximum.accumulate([y for _, _, y in spans])
                ahead = np.searchsorted(begins, e, "left")
                clear = (ahead == 0) | (reach[np.maximum(ahead, 1) - 1] <= s)
                s, e = s[clear], e[clear]
            spans = sorted(spans + [("crf", x, y) for x, y in zip(s.tolist(), e.tolist(), strict=True)], key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
        out.append(spans)
    return out


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each merged span replaced by `[SECRET]`."""
    out, last = [], 0
    for _, s, e in spans:
        if s >= last:
            out += [text[last:s], "[SECRET]"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def _apply(docs: DataFrame, field: Field | None, keep: list[str], out: dict[str, str], row, whole: bool = False) -> DataFrame:
    """`keep` columns and the values that `row` (the text if `whole`, spans) gives for each text."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kinds = [pa.int64() if v == "long" else pa.string() for v in out.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.num_columns - 1)
            data, at = tk.utf8(column)
            for start, end, part, begins in tk.chunks(data, at):
                made = [row(column[start + r].as_py() if whole else None, spans) for r, spans in enumerate(scan_batch(part, begins, shared.value))]
                columns = [pa.array(v, k) for v, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, end - start) for c in b.columns[:-1]), *columns], [*keep, *out])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"`{k}` {v}" for k, v in out.items())])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(unused(docs, "text_in")[0])).mapInArrow(run, schema)


def scan(docs: DataFrame, field: Field | None, keep: list[str]) -> DataFrame:
    """`keep` columns, then n_assign, n_access, n_hex, base_sha256, spans and n_secrets of every text."""

    def row(_: None, spans: list[tuple[str, int, int]]) -> tuple:
        base = [s for s in spans if s[0] != "crf"]
        show = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in xs)
        return *(sum(s[0] == k for s in base) for k in KINDS[:3]), hashlib.sha256(show(base).encode()).hexdigest(), show(spans), len(spans)

    out = {"n_assign": "long", "n_access": "long", "n_hex": "long", "base_sha256": "string", "spans": "string", "n_secrets": "long"}
    return _apply(docs, field, keep, out, row)


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """`docs` with every secret in `text` replaced; all other columns stay."""
    (name,) = unused(docs, "redacted")
    done = _apply(docs, field, docs.columns, {name: "string"}, lambda text, spans: (redacted(text, spans) if spans else text,), whole=True)
    return done.select(*[F.col(name).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def secret_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (and n_secrets) of every document."""
    return scan(docs.select("doc_id", "text"), train(docs, **options), ["doc_id"])
