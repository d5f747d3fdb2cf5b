"""Substring dedup: seed and extend over words.

A *repeat* is a run of at least ``least`` consecutive words that also stands in a
document with a smaller doc_id.  Every word that such a run covers is removed;
runs are judged on the input, not on what is left.

Method.  Seeds are winnowed anchors: of the ``least - k + 1`` k-word grams that a
window of ``least`` words holds, the one of smallest hash.  Equal windows choose
equal anchors, so documents that share a repeat meet on a shared anchor.  An
anchor that stands in one document only ends there.

Extension.  A shared anchor is extended both ways to its *fragment*: the words of all
windows that choose it there, up to ``least - k`` words on either side.  Where a
fragment also stands in a smaller document, the match extends over all of it, and
adjoining fragments grow into maximal repeats without a look at their windows.  What
is left are the ends of matches: anchors that stand in several different fragments.
There the first copy of each fragment (the smallest document that has it) is compared
with those of the others window by window.  That is enough: if a window of a first
copy stands in a smaller document, it stands in the first copy of that document's
fragment, whose document is smaller still or the same.

Scale.  Anchors are about 2 / (least - k + 2) of the positions and only two longs
wide; fragments are fewer and windows are made only at ends of matches.  Documents of
an anchor, fragment or window are never brought together: each is reduced to its
smallest (and largest) doc_id by partial aggregation, and the rows go back by
equi-joins with written tables, which Spark may split where they are skewed.  Text is
dealt out only where a document takes part in a step: bitmaps of fixed size sort most
others out where they are read.

Defined cases: null, empty and blank text has no words; a null doc_id is neither
smaller nor larger, so such rows keep all and remove nothing; repeated rows of one
doc_id do not remove each other's words (a tie is not smaller); a very long text is
worked on as a whole, in one row; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcount.llm import _text
from veilcount.llm._scratch import Scratch
from veilcount.llm._sieve import marked, sieve, sifted

LEAST, SEED = 13, 5


def _anchors(h: np.ndarray, first: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of the window that starts at each word, whether that window lies in one document)."""
    ok = _text.inside(first, least)
    g, width, have = _text.grams(h, k), least - k + 1, 1
    while have < width:
        step = min(have, width - have)
        g = np.minimum(g[:-step], g[step:]) if len(g) > step else g[:0]
        have += step
    return g[: len(ok)], ok


def _seeds(least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for i, _, w in _text.word_blocks(batch.column(1)):
                a, ok = _anchors(w.hashes(), w.first, least, k)
                doc = w.doc()[: len(a)]
                new = ok.copy()
                new[1:] &= (a[1:] != a[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(_text.signed(a[new])), pa.array(ids[i + doc[new]])], ["anchor", "doc"])

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; null counts as empty."""
    lengths = np.nan_to_num(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0))).astype(np.int64)
    return np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(lengths)])


class _Block:
    """Hashes of a block's windows, and the fragments of its documents."""

    def __init__(self, w: _text.Words, least: int, k: int):
        self.first, self.least, self.width = w.first, least, least - k + 1
        h = w.hashes()
        self.anchor, _ = _anchors(h, w.first, least, k)
        self.one, self.two = _text.grams(h, least), _text.grams(w.hashes(1), least, 1)

    def fragments(self, d: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of document d: its first window, and the first and last window (from there on) and two hashes of each fragment."""
        lo = int(self.first[d])
        a = self.anchor[lo : max(lo, int(self.first[d + 1]) - self.least + 1)]
        at = np.arange(len(a))
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        start = np.maximum.accumulate(np.where(new, at, 0))
        head = np.flatnonzero((at - start) % self.width == 0)  # an anchor that recurs within its windows makes several
        tail = np.append(head[1:], len(a))[: len(head)] - 1
        length = (tail - head).astype(_text.U)
        f1, f2 = (_text.mix(x[lo + head] + _text.mix(x[lo + tail] ^ (length + _text.U(1)) * _text.U(0x9E3779B97F4A7C15))) for x in (self.one, self.two))
        return lo, head, tail, f1, f2


def _fragments(least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            shared, at = _lists(batch.column(2))
            for i, j, w in _text.word_blocks(batch.column(1)):
                block, out = _Block(w, least, k), []
                for d in range(i, j):
                    lo, head, _, f1, f2 = block.fragments(d - i)
                    anchor = _text.signed(block.anchor[lo + head])
                    pick = np.flatnonzero(np.isin(anchor, shared[at[d] : at[d + 1]]))
                    pick = pick[np.unique(f1[pick], return_index=True)[1]]
                    out.append((anchor[pick], _text.signed(f1[pick]), (f2[pick] >> _text.U(32)).astype(np.uint32).view(np.int32), np.full(len(pick), ids[d])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["anchor", "f1", "f2", "doc"])

    return run


def _spread(lo: int, head: np.ndarray, tail: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Windows of the chosen fragments."""
    size = (tail - head + 1)[chosen]
    return lo + np.repeat(head[chosen] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _windows(least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            named, at = _lists(batch.column(2))
            for i, j, w in _text.word_blocks(batch.column(1)):
                block, out = _Block(w, least, k), []
                for d in range(i, j):
                    lo, head, tail, f1, _ = block.fragments(d - i)
                    pick = _spread(lo, head, tail, np.flatnonzero(np.isin(_text.signed(f1), named[at[d] : at[d + 1]])))
                    order = pick[np.lexsort((block.two[pick], block.one[pick]))]
                    w1, w2 = block.one[order], block.two[order] >> _text.U(32)
                    new = np.ones(len(w1), bool)
                    new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
                    out.append((_text.signed(w1[new]), w2[new].astype(np.uint32).view(np.int32), np.full(int(new.sum()), ids[d])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["w1", "w2", "doc"])

    return run


def _cut(least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, at = _lists(batch.column(2))
            single, by = _lists(batch.column(3))
            for i, j, w in _text.word_blocks(batch.column(1)):
                block = _Block(w, least, k) if at[i] < at[j] or by[i] < by[j] else None
                raw = w.buf.tobytes()
                n, gone, sha, runs = w.counts(), np.zeros(j - i, np.int64), [], np.zeros(j - i, np.int64)
                for d in range(i, j):
                    words = raw[w.offsets[d - i] : w.offsets[d - i + 1]].split()
                    if at[d] < at[d + 1] or by[d] < by[d + 1]:
                        lo, head, tail, f1, _ = block.fragments(d - i)
                        count = int(n[d - i])
                        hit = np.isin(_text.signed(block.one[lo : lo + max(0, count - least + 1)]), single[by[d] : by[d + 1]])
                        hit[_spread(0, head, tail, np.flatnonzero(np.isin(_text.signed(f1), whole[at[d] : at[d + 1]])))] = True
                        edge = np.zeros(count + 1, np.int64)
                        edge[: len(hit)] += hit
                        edge[least : least + len(hit)] -= hit
                        covered = np.cumsum(edge)[:-1] > 0
                        gone[d - i] = covered.sum()
                        runs[d - i] = (np.diff(covered.astype(np.int8), prepend=0) == 1).sum()
                        words = [x for x, c in zip(words, covered.tolist(), strict=True) if not c]
                    sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(gone), pa.array(sha), pa.array(runs)], ["doc_id", "n_words", "n_removed", "kept_sha256", "n_repeats"])

    return run


def repeats(docs: DataFrame, scratch: Scratch, least: int = LEAST, k: int = SEED) -> DataFrame:
    """(doc, fragments, windows): per document the hashes of its fragments, and of its single windows, that a smaller document also has."""
    put, drop = scratch.put, scratch.drop
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")

    def texts(lists: DataFrame) -> DataFrame:
        """(doc_id, text, list) of the documents of lists (doc, list)."""
        some = sifted(known, F.xxhash64("doc_id"), sieve(lists, F.xxhash64("doc")))
        return some.join(lists, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "list")

    seeds = known.mapInArrow(_seeds(least, k), "anchor bigint, doc bigint")  # made twice, as that costs less than writing them
    shared = put(seeds.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("anchor"), "shared")
    picked = put(seeds.join(shared, "anchor", "left_semi").groupBy("doc").agg(F.collect_set("anchor").alias("list")), "picked")
    drop(shared)
    found = put(texts(picked).mapInArrow(_fragments(least, k), "anchor bigint, f1 bigint, f2 int, doc bigint"), "fragments")
    drop(picked)
    first = put(found.groupBy("anchor", "f1", "f2").agg(F.min("doc").alias("home"), F.max("doc").alias("hi")), "first")
    copied = first.where("home < hi").select("f1", "f2", "home")
    extended = found.join(copied, ["f1", "f2"]).where("doc > home").select("doc", F.col("f1").alias("fragment"), F.lit(None).cast("bigint").alias("window"))
    several = put(first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "several")
    ends = put(first.join(several, "anchor", "left_semi").groupBy(F.col("home").alias("doc")).agg(F.collect_set("f1").alias("list")), "ends")
    drop(several)
    windows = put(texts(ends).mapInArrow(_windows(least, k), "w1 bigint, w2 int, doc bigint"), "windows")
    drop(ends)
    lowest = put(windows.groupBy("w1", "w2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("w1", "w2", "lo"), "lowest")
    later = windows.join(lowest, ["w1", "w2"]).where("doc > lo").select("doc", F.lit(None).cast("bigint").alias("fragment"), F.col("w1").alias("window"))
    out = put(extended.union(later).groupBy("doc").agg(F.collect_set("fragment").alias("fragments"), F.collect_set("window").alias("windows")), "repeats")
    drop(found, first, windows, lowest)
    return out


def dedup(docs: DataFrame, least: int = LEAST, k: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), n_repeats (maximal repeats)."""
    scratch = Scratch(docs.sparkSession)
    found = repeats(docs, scratch, least, k)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    keyed = marked(keyed, F.xxhash64("doc_id"), sieve(found, F.xxhash64("doc")), "held")
    none = F.lit(None).cast("array<bigint>")
    whole = keyed.where("not held").select("doc_id", "text", none.alias("fragments"), none.alias("windows"))
    held = keyed.where("held").join(found, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "fragments", "windows")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_repeats bigint"
    return whole.mapInArrow(_cut(least, k), schema).union(held.mapInArrow(_cut(least, k), schema))
