"""Best-fit packing of tokenised documents into sequences of a fixed length.

Method: bounded-space online best-fit.  A fixed number of bins is open; a bitset
keyed by free space finds the fullest open bin that still takes a piece in a few
word operations.  When none does and all bins are open, the fullest is closed.

Two steps.  ``pieces`` tokenises each document where it is read (no shuffle) and
cuts only documents longer than a sequence.  ``pack`` deals the small piece rows
(no text, no ids) into partitions of about ``rows_per_task`` rows by a hash of
document and piece, and packs each partition on its own, so a lost task can be
repeated with the same outcome.  The number of partitions follows the number of
rows; each leaves at most ``open_bins`` bins that are not full.

Defined cases: null or empty text is a document of the single end id; repeated
rows are packed each on their own; a null doc_id stays null; an empty table gives
an empty result; pieces that tie in the hash they are dealt by are placed in the order
of doc_id, piece, length and crc; of bins with equal free space the last one that got
there is taken; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilcount.llm import _text
from veilcount.llm._chunks import ChunkIds, joined, ragged
from veilcount.llm._scratch import Scratch

SEQUENCE, END_ID, OPEN_BINS, ROWS_PER_TASK = 4096, 1, 512, 200_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

_caches: dict[str, tuple] = {}
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[c for c in range(0x80) if chr(c).isalpha()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


def _tokenizer(path: str) -> tuple:
    if path not in _caches:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        _caches[path] = t, ChunkIds(lambda texts: _encoded(t, texts))
    return _caches[path]


def _encoded(t, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each text, all ids), of many texts at a call: a special token between two holds them apart."""
    mark, of = _SPECIAL[1].decode(), 100
    end = t.token_to_id(mark)
    if end is not None:
        found = t.encode_batch_fast([mark.join(texts[k : k + of]) + mark for k in range(0, len(texts), of)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
        cut = np.flatnonzero(ids == end)
        if len(cut) == len(texts):  # else one of them holds the mark itself
            return np.diff(cut, prepend=-1) - 1, ids[ids != end]
    return joined([e.ids for e in t.encode_batch(texts, add_special_tokens=False)])


def _chunks(w: _text.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans that this tokenizer treats alone: it never joins ids over white space, nor over the step
    from a Latin letter to ASCII punctuation, nor from ASCII punctuation other than ' to an ASCII letter.

    Returns starts, ends, the index of each document's first chunk, and the bytes in lower case where
    that can't change the ids (no combining marks about).
    """
    buf, n = w.buf, len(w.buf)
    if not n:
        return w.start, w.end, w.first, buf
    one = np.zeros(n + 1, bool)
    punct, alpha = _PUNCT[buf], _ALPHA[buf]
    p1 = np.zeros(n, np.uint8)
    p1[1:] = buf[:-1]
    p2 = np.zeros(n, np.uint8)
    p2[2:] = buf[:-2]
    latin = (p1 >= 0x80) & (p1 < 0xC0) & (p2 >= 0xC3) & (p2 <= 0xC9) & ~((p2 == 0xC3) & ((p1 == 0x97) | (p1 == 0xB7)))
    one[:n] = punct & (_ALPHA[p1] | latin)
    one[:n] |= alpha & _PUNCT[p1] & (p1 != 0x27)
    one[w.start] = True
    start = np.flatnonzero(one[:n] & ~_text._SEP[buf])
    stop = one.copy()
    stop[w.end] = True
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, start, "right")]
    lower = _LOWER[buf]
    if (buf >= 0xCA).any():  # a mark may follow: keep the case of such words
        marks = np.concatenate([[0], np.cumsum(buf >= 0xCA)])
        for a, b in zip(*(x[marks[w.end] > marks[w.start]] for x in (w.start, w.end)), strict=True):
            lower[a:b] = buf[a:b]
    return start, end, np.searchsorted(start, w.offsets), lower


def block_ids(w: _text.Words, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents, offset of each document's) of a block; no end ids."""
    tokenizer, cache = _tokenizer(path)
    start, end, first, lower = _chunks(w)
    if len(start):
        h = _text.hash_spans(lower, start, end)
        raw = lower.tobytes()
        [(lengths, ids)] = cache.lookup(h, lambda i: (raw[start[i] : end[i]].decode(),))
    else:
        lengths, ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
    total = np.concatenate([[0], np.cumsum(lengths)])[first]
    raw = w.buf.tobytes()
    if any(s in raw for s in _SPECIAL):  # strings of special tokens hold across chunks: such documents go to the tokenizer whole
        parts = []
        for d in range(len(first) - 1):
            text = raw[w.offsets[d] : w.offsets[d + 1]]
            whole = any(s in text for s in _SPECIAL)
            parts.append(np.array(tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.int32) if whole else ids[total[d] : total[d + 1]])
        ids = np.concatenate(parts)
        total = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    return ids, total


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Tokenised documents as pieces of at most ``sequence`` ids; the crc is that of little-endian unsigned 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, w in _text.word_blocks(batch.column(1)):
                found, total = block_ids(w, tokenizer_path)
                m = j - i
                full = np.full(len(found) + m, end_id, "<u4")
                keep = np.ones(len(full), bool)
                keep[total[1:] + np.arange(m)] = False
                full[keep] = found
                begin, length = total[:-1] + np.arange(m), np.diff(total) + 1
                count = -(-length // sequence)
                row = np.repeat(np.arange(m), count)
                piece = ragged(np.zeros(m, np.int64), count)
                start = piece * sequence
                size = np.minimum(sequence, length[row] - start)
                at = begin[row] + start
                view = memoryview(full).cast("B")
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist(), strict=True)), np.int64, len(at))
                yield pa.RecordBatch.from_arrays([ids.slice(i, m).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, PIECES)


class Bins:
    """Open bins by free space; ``place`` gives (bin, offset)."""

    def __init__(self, size: int, open_bins: int, first: int = 0):
        self.size, self.most, self.next = size, open_bins, first
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits = 0
        self.open = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            b = self._take(free)
        else:
            if self.open >= self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            b, free = self.next, self.size
            self.next += 1
        left = free - length
        if left:
            self.by_free[left].append(b)
            self.bits |= 1 << left
            self.open += 1
        return b, self.size - free


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, end_id: int = END_ID, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cut = scratch.put(pieces(docs, tokenizer_path, sequence, end_id), "pieces")
    parts = max(1, -(-cut.count() // rows_per_task))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bins = Bins(sequence, open_bins, TaskContext.get().partitionId() << 40)
        for x in batches:
            placed = np.array([bins.place(n) for n in x["length"].tolist()], np.int64).reshape(-1, 2)
            yield x.assign(sequence_id=placed[:, 0], offset=placed[:, 1])

    order = F.xxhash64("doc_id", "piece", "ids_crc32", "length")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in cut.schema] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    dealt = cut.repartition(parts, order).sortWithinPartitions(order, "doc_id", "piece", "length", "ids_crc32")
    return scratch.put(dealt.mapInPandas(run, schema), "packed")
