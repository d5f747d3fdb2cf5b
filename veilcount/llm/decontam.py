"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits.  Every n-gram of an item is a seed
(``SPAN`` = 1), so whether a document is found does not depend on other documents.
With a wider span only the rarest that occurs at all is, in every stretch of that many
consecutive n-grams, by document frequency over the whole corpus; that loses copies
whose kept runs are short.  What shares no run of ``GRAM`` words with an item is not
aligned, though its score may reach the threshold (every third word edited, or a word
put in after every second).  A seed found in a document proposes the stretch around it; local alignment
(match +2, mismatch and gap -1) scores it, and score / (2 x item length) of at
least ``THRESHOLD`` is a leak.

Scale: the benchmark is a query set held against all rows.  It is taken in blocks of
at most ``BLOCK_WORDS`` words, each sent to the executors whole; the scan of the
documents is narrow, as is the first one of a wider span, of which what comes back is bounded by the block.

Stretches of one item that lie close are aligned as one; one that is longer than
``WINDOW`` items (the item recurs, or a very long text is full of its seeds) is cut into
parts that overlap by three, and no alignment of a positive score is longer than that.
Alignments are computed in batches of at most ``AREA`` cells a step, so memory does not
grow with the text.

Defined cases: null or empty documents and items match nothing, items shorter than
the n-gram neither; repeated rows give repeated results; of several alignments of one
document and item the best counts, of equal ones the last in the text; a null doc_id or
item_id is carried through; empty tables give an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.llm import _text
from veilcount.llm._normal import normal_words

GRAM, SPAN, THRESHOLD, BLOCK_WORDS = 3, 1, 0.5, 2_000_000
MATCH, OTHER, SLACK = 2, -1, 8
#: The longest window in lengths of its item, and cells of the alignment table that are worked on at once.
WINDOW, AREA = 8, 1 << 20
SCHEMA = "doc_id bigint, item_id bigint, score double, n_matched bigint, word_start bigint, word_end bigint"
_BITS = 20


class Items(NamedTuple):
    """A block of benchmark items: ids, word hashes of all, and first[i]:first[i + 1] those of item i."""

    ids: list
    words: np.ndarray
    first: np.ndarray

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, item, position in the item) of every n-gram."""
        g, ok = _text.grams(self.words, n), _text.inside(self.first, n)
        at = np.flatnonzero(ok)
        item = np.searchsorted(self.first, at, "right") - 1
        return g[at], item, at - self.first[item]


class Keys:
    """Sorted hashes with a bit table before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.keys >> _text.U(64 - _BITS)] = True

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in g that are known, and their index among the keys."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[g >> _text.U(64 - _BITS)])
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        hit = self.keys[k] == g[at]
        return at[hit], k[hit]


def items(rows: list) -> Items:
    texts = pa.array([r["text"] for r in rows], pa.string())
    words, counts = [np.zeros(0, _text.U)], []
    for _, _, w in normal_words(texts):
        words.append(w.hashes())
        counts.append(w.counts())
    return Items([r["item_id"] for r in rows], np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64))


def _frequencies(keys: Keys, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(keys.keys), np.int64)
        for batch in batches:
            for _, _, w in normal_words(batch.column(0)):
                g = _text.grams(w.hashes(), n)
                at, k = keys.find(g)
                ok = _text.inside(w.first, n)[at]
                pairs = np.unique(w.doc()[at[ok]] * np.int64(len(df)) + k[ok])
                df += np.bincount(pairs % max(len(df), 1), minlength=len(df))
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(df[used])], ["k", "df"])

    return run


def seeds(block: Items, keys: Keys, df: np.ndarray, n: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, item, position) of the rarest n-gram of every stretch of ``span`` n-grams of each item."""
    g, item, pos = block.grams(n)
    if span == 1:
        return g, item, pos
    rare = df[np.searchsorted(keys.keys, g)] if len(g) else np.zeros(0, np.int64)
    rare = np.where(rare > 0, rare, np.iinfo(np.int64).max)  # what occurs nowhere seeds nothing
    keep = np.zeros(len(g), bool)
    bounds = np.searchsorted(item, np.arange(len(block.ids) + 1))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        for s in range(lo, max(lo + 1, hi - span + 1)):
            if lo < hi:
                keep[s + int(np.argmin(rare[s : min(hi, s + span)]))] = True
    return g[keep], item[keep], pos[keep]


def align(item: list[np.ndarray], window: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of item b against window b, for all b at once: (best score, item end, window end)."""
    m, n = np.array([len(x) for x in item]), np.array([len(x) for x in window])
    left = np.zeros((len(item), m.max(initial=1)), _text.U)
    right = np.zeros((len(item), n.max(initial=1)), _text.U)
    for b, (x, y) in enumerate(zip(item, window, strict=True)):
        left[b, : len(x)], right[b, : len(y)] = x, y
    column = np.arange(right.shape[1] + 1, dtype=np.int32)
    real = np.arange(right.shape[1]) < n[:, None]
    h = np.zeros((len(item), right.shape[1] + 1), np.int32)
    best = np.zeros(len(item), np.int32)
    row_end, col_end = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    for i in range(left.shape[1]):
        step = np.where((right == left[:, i : i + 1]) & real, MATCH, OTHER)
        t = np.maximum(h + OTHER, 0)
        t[:, 1:] = np.maximum(t[:, 1:], h[:, :-1] + step)
        h = np.maximum.accumulate(t - OTHER * column, axis=1) + OTHER * column
        h[m <= i] = 0
        at = h.argmax(axis=1)
        top = h[np.arange(len(item)), at]
        new = top > best
        best[new], row_end[new], col_end[new] = top[new], i + 1, at[new]
    return best, row_end, col_end


def _leaks(block: Items, seed: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, threshold: float):
    keys = Keys(seed[0])
    order = np.argsort(seed[0], kind="stable")
    g, item, pos = (x[order] for x in seed)
    lo, hi = np.searchsorted(g, keys.keys), np.searchsorted(g, keys.keys, "right")
    size = np.diff(block.first)

    def stretches(w: _text.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, first word, last word + 1): seeds of one item that lie close make one stretch."""
        at, k = keys.find(_text.grams(h, n))
        ok = _text.inside(w.first, n)[at]
        at, k = at[ok], k[ok]
        times = hi[k] - lo[k]
        which = np.repeat(lo[k] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        place = np.repeat(at, times)
        doc = np.searchsorted(w.first, place, "right") - 1
        found, diagonal = item[which], place - pos[which]
        order = np.lexsort((diagonal, found, doc))
        doc, found, diagonal = doc[order], found[order], diagonal[order]
        a = np.maximum(w.first[doc], diagonal - SLACK)  # both ends grow within a document and item
        z = np.minimum(w.first[doc + 1], diagonal + size[found] + SLACK)
        new = np.ones(len(a), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1]) | (a[1:] > z[:-1])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(a))[: len(head)] - 1
        doc, found, a, z = doc[head], found[head], a[head], z[last]
        most = WINDOW * size[found] + 2 * SLACK
        step = most - 3 * size[found] - SLACK
        parts = 1 + np.maximum(0, -(-(z - a - most) // step))
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        doc, found, a, z, most, step = (np.repeat(x, parts) for x in (doc, found, a, z, most, step))
        return doc, found, a + nth * step, np.minimum(z, a + nth * step + most)

    def rounds(length: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of rows of at most AREA cells a step (or one row)."""
        s, longest = 0, 0
        for e, x in enumerate(length.tolist()):
            longest = max(longest, x)
            if e > s and (e + 1 - s) * longest > AREA:
                yield s, e
                s, longest = e, x
        if s < len(length):
            yield s, len(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first_row, _, w in normal_words(batch.column(1)):
                h = w.hashes()
                doc, found, begin, end = stretches(w, h)
                order = np.lexsort((end - begin, size[found]))
                doc, found, begin, end = doc[order], found[order], begin[order], end[order]
                best: dict[tuple[int, int], tuple] = {}
                for s, e in rounds(end - begin):
                    left = [block.words[block.first[b] : block.first[b + 1]] for b in found[s:e]]
                    right = [h[a:z] for a, z in zip(begin[s:e], end[s:e], strict=True)]
                    score, row, col = align(left, right)
                    share = score / (MATCH * size[found[s:e]])
                    for i in np.flatnonzero(share >= threshold):
                        _, back_row, back_col = align([left[i][: row[i]][::-1]], [right[i][: col[i]][::-1]])
                        d, b, a = int(doc[s + i]), int(found[s + i]), int(begin[s + i])
                        got = (float(share[i]), int(back_row[0]), a + int(col[i] - back_col[0]) - int(w.first[d]), a + int(col[i]) - int(w.first[d]))
                        best[d, b] = max(best.get((d, b), got), got)
                rows = sorted(best.items())
                columns = list(zip(*[(ids[first_row + d], block.ids[b], *x) for (d, b), x in rows], strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, n: int = GRAM, span: int = SPAN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per (document, item) that leaks: doc_id, item_id, score, words of the item in the alignment, and its place in the document's words."""
    tests = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text")).where("text is not null")
    size = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-int(size) // (4 * block_words)))
    words = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).where("text is not null")
    out = None
    for b in range(count):
        block = items(tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).orderBy("item_id", "text").collect())
        keys = Keys(block.grams(n)[0])
        df = np.zeros(len(keys.keys), np.int64)
        if span > 1 and len(df):
            for r in words.select("text").mapInArrow(_frequencies(keys, n), "k bigint, df bigint").groupBy("k").agg(F.sum("df").alias("df")).collect():
                df[r["k"]] = r["df"]
        found = words.mapInArrow(_leaks(block, seeds(block, keys, df, n, span), n, threshold), SCHEMA)
        out = found if out is None else out.union(found)
    return out
