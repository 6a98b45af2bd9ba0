"""Substring dedup of words: matching statistics against suffix automata of earlier passages.

Passages that share an anchor (see `anchors`) make a reference shard.  Its passages are streamed in
corpus order through the shard's suffix automaton, which holds the passages before: the length of
the longest match that ends at each word is the word's matching statistic.  Where it reaches the
window length the window starts earlier in the corpus; the maximal spans of such windows go.

Edge cases: null and empty texts have no words; texts shorter than a window lose nothing; a null id
takes no part and keeps its words; rows that repeat an id are documents of their own, in the order of a
hash of their texts, but rows equal in id and text count as one; windows are judged on the input; an empty table gives an empty result; only doc_id and text are read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm import repeats
from recordloom.llm import textkit as tk

LENGTH, GRAM, GROUP = 20, 5, 1_024


class SuffixAutomaton:
    """Suffix automaton of several sequences, grown item by item."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _copy(self, p: int, q: int, item: int) -> int:
        """A state for the strings of `q` that end right after state `p`."""
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(item) == q:
            self.next[p][item] = new
            p = self.link[p]
        return new

    def extend(self, last: int, item: int) -> int:
        """Add `item` after the prefix whose state is `last`; gives the new prefix's state."""
        q = self.next[last].get(item)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._copy(last, q, item)
        cur = len(self.next)
        self.next.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and item not in self.next[p]:
            self.next[p][item] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][item]
            self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._copy(p, q, item)
        return cur

    def add(self, items: list[int]) -> None:
        last = 0
        for item in items:
            last = self.extend(last, item)

    def matching(self, items: list[int]) -> list[int]:
        """For each item, the length of the longest match that ends with it."""
        state, size, out = 0, 0, []
        for item in items:
            while state and item not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            to = self.next[state].get(item)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out


def earlier_windows(passages: list[list[int]], length: int) -> list[tuple[int, int]]:
    """(passage, offset) of the windows of each passage that also start in an earlier one.

    The passages are all about one anchor and in corpus order.  A window has its anchor at one place,
    so no window of a passage repeats within it, and windows of two passages of one text never overlap
    in their starts.
    """
    automaton, found = SuffixAutomaton(), []
    for k, items in enumerate(passages):
        if k:
            found += [(k, end - length) for end, size in enumerate(automaton.matching(items), 1) if size >= length]
        automaton.add(items)
    return found


def word_items(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = tk.words(data, at)
    return tk.word_codes(data, starts, ends), first


def earlier_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_size: int = GROUP) -> DataFrame:
    """(doc_id, text_key, span) in words, of every window of `repeats.keyed` texts that also starts earlier in the corpus."""
    shape = repeats.Shape(word_items, length, gram, group_size, raw=False)
    found = repeats.places(docs, shape)
    each, left = repeats.contexts(found)
    later = found.join(each.select("gram", "context", "first"), ["gram", "context"]).where("doc_id <> first.doc_id or text_key <> first.text_key or place <> first.place")
    whole = later.select("doc_id", "text_key", repeats.span(F.col("place"), shape).alias("span"))
    rows = repeats.standing(docs, left, shape)

    def judge(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gram_, doc, key, start = (table.column(c).to_numpy() for c in ("gram", "doc_id", "text_key", "start"))
        codes, first = repeats.code_rows(table.column("codes").combine_chunks(), None)
        edges = np.flatnonzero(np.concatenate([[True], gram_[1:] != gram_[:-1], [True]]))
        out = []
        items = codes.tolist()
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            # equal rows give equal passages, of which one is enough
            mine = [k for k in range(a, b) if k == a or (doc[k], key[k], start[k]) != (doc[k - 1], key[k - 1], start[k - 1])]
            passages = [items[first[k] : first[k + 1]] for k in mine]
            out += [(doc[mine[k]], key[mine[k]], start[mine[k]] + at) for k, at in earlier_windows(passages, length)]
        found = np.array(out, np.int64).reshape(-1, 3)
        return found[:, 0], found[:, 1], found[:, 2], np.full(len(found), length)

    detail = repeats.in_groups(rows.where(F.col("n_contexts") <= group_size), judge)
    hot = repeats.dealt_windows(rows.where(F.col("n_contexts") > group_size), shape, None)
    begins = hot.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "text_key", "start")).alias("first"), F.count("*").alias("m")).where("m > 1").select("w1", "w2", "first")
    again = hot.join(begins, ["w1", "w2"]).where("doc_id <> first.doc_id or text_key <> first.text_key or start <> first.start").select("doc_id", "text_key", F.shiftleft("start", repeats.SPAN_BITS).bitwiseOR(F.lit(length)).alias("span"))
    return whole.unionAll(detail).unionAll(again)


def substring_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every text."""

    def fn(data: np.ndarray, at: np.ndarray, spans: pa.Array) -> list:
        starts, ends, first = tk.words(data, at)
        gone = repeats.covered(spans, first)
        total = np.concatenate([[0], np.cumsum(gone)])
        kept = []
        for r in range(len(at) - 1):
            a, b = first[r], first[r + 1]
            text = data[at[r] : at[r + 1]].tobytes()
            keep = np.flatnonzero(~gone[a:b]) + a
            kept.append(hashlib.sha256(b" ".join([text[s:e] for s, e in zip((starts[keep] - at[r]).tolist(), (ends[keep] - at[r]).tolist(), strict=True)])).hexdigest())
        return [np.diff(first), total[first[1:]] - total[first[:-1]], kept]

    texts = repeats.keyed(docs)
    return repeats.with_spans(texts, earlier_spans(texts, **options), {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}, fn)
