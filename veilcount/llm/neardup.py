"""Near-duplicate classes by improved consistent weighted sampling.

A text is the weighted set of its five-word shingles (a text of one to four words
is one shingle): weight = term frequency x idf.  Two texts are linked when their
weighted Jaccard similarity sum(min) / sum(max) is at least ``threshold``; a class
is a connected component of links, and copies of one text share a class.

idf is 1 + ln((1 + N) / (1 + df)), over all N rows, from the exact document frequency
of every shingle, and is divided by its value at df = 1, which leaves similarities as
they are.  Shingles are counted in blocks of ``BLOCK_BYTES`` of texts: a block sends each
of its distinct shingles once, with the number of its documents that have it, as packed
hashes to one of ``PARTS`` ranges, so a shingle that every document has is no hot key; a
range adds up and answers each block with those of its shingles that have df > 1.  No
task sees more than a block or a range, nothing is gathered or broadcast.  In large groups
of near copies what differs weighs more than what is shared, as in any tf-idf, so such
copies must agree in more of their text to be linked.  ``hot`` gives another idf, of full
weight up to that document share: min(1, ln((N + 100) / df) / ln(1 / hot)), at least 0.05.

Sampling: for each of ``BANDS * ROWS`` hash functions the sampled (shingle, t) of Ioffe
(2010), with the Gamma(2, 1) variables from quantile tables indexed by hash bits.
Three samples make a band; texts that agree in one of 14 bands are candidates.  At
similarity 0.8 a link is missed by banding with probability 0.488^14 = 4e-5.  Before
whole texts are compared, one-permutation sketches of 512 bins sort out pairs that
are more than ``SIGMAS`` standard deviations below the threshold.  The sketch is of
(shingle, occurrence) pairs, each kept with its idf as probability by a hash of its
own, so agreement of two sketches estimates the weighted similarity.  A sketch of few
elements lets much pass that is not alike, so two bounds that hold without exception come
with it: what two texts share is no more than what either has of shingles with df > 1, as
one with df = 1 is in no other text, and no more than the sum, over ``SHARES`` classes of
such shingles by hash, of the smaller of their weights in the class.  ``sigmas=None`` turns
sketches and bounds off.  What is left is verified on whole texts.

Groups: no bucket is gathered or expanded into all its pairs.
1. Leaders.  In each bucket the most central member (by the sizes of all buckets that
   it is in) of each of ``LEADERS`` hash classes is compared with every member: a
   number of pairs linear in the members.  Their links join nearly all that belongs
   together: a family with links among its members has buckets of its own in about
   half of the bands.
2. The rest, exactly.  Members that are not in the component of their bucket's first
   leader are compared, by sketches inside a join, with the members of other
   components.  Buckets are cut into blocks of ``BLOCK`` members by hash and the join
   is on (bucket, block, block), so no task gets more than BLOCK x BLOCK pairs of a
   bucket, however large that is; what passes the sketches is verified.
So every candidate pair is either compared or already joined through others.  The
second step costs the square of a group only in members that no leader reaches and
that sketches and bounds leave, that is, of a group whose members lie just below the
threshold.  Texts of documents without a surviving pair are not shuffled: a bitmap of
fixed size, by hash of doc_id, sorts most of them out where they are read (were it
full, rows would take the exact join as they would without it).

Defined cases: texts without words (null, empty, blank) are alike to nothing; rows
of one doc_id count as one document, with all their texts; rows with null doc_id have
no class and form no link, but count in idf, as every row does; a very long text is
shingled as a whole, and pairs of texts reach Python in batches of bounded bytes; ties
(equal centrality) are broken by a hash of doc_id, and the class is named by its
smallest doc_id; an empty table gives an empty result; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.llm import _text
from veilcount.llm._graph import components
from veilcount.llm._scratch import Scratch
from veilcount.llm._sieve import sieve, sifted

WORDS, THRESHOLD, BANDS, ROWS, BINS, SIGMAS = 5, 0.8, 14, 3, 512, 4.0
HOT, FLOOR, PSEUDO = 1 / 32, 0.05, 100
#: Leaders of a bucket, and the most of its members that meet as many others in one task.
LEADERS, BLOCK = 2, 4096
#: Classes of shingles in which weights are added up to bound what two texts share.
SHARES = 64
#: What sketches and bounds compare of two texts, beside the sketch.
CARD = ("kept", "elements", "total", "shared", "shares")
#: Texts whose shingles are counted together, in bytes, and the ranges of hashes that counts are added up in.
BLOCK_BYTES, PARTS = 1 << 22, 1024
U = _text.U


class Frequencies(NamedTuple):
    """Document frequencies of the shingles that more than one row has; keys are sorted."""

    keys: np.ndarray
    values: np.ndarray

    def of(self, g: np.ndarray) -> np.ndarray:
        out = np.ones(len(g), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            hit = self.keys[at] == g
            out[hit] = self.values[at[hit]]
        return out


def idf(df: np.ndarray, n: int, hot: float | None = None) -> np.ndarray:
    """Weights of shingles that df of n rows have (see the module's text)."""
    if hot is None:
        return (1 + np.log((1 + n) / (1 + df))) / (1 + np.log((1 + n) / 2))
    out = np.ones(len(df))
    on = df > hot * n
    if on.any():
        out[on] = np.clip(np.log((n + PSEUDO) / df[on]) / np.log(1 / hot), FLOOR, 1)
    return out


def shingles(w: _text.Words, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a block: (hash, document, term frequency), by document."""
    h = w.hashes()
    n = w.counts()
    g = _text.grams(h, k)
    ok = _text.inside(w.first, k)
    found, doc = g[ok], w.doc()[: len(g)][ok]
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            whole = _text.mix(_text.grams(h, size)[w.first[short]] + U(size))
            at = np.searchsorted(doc, short)
            found, doc = np.insert(found, at, whole), np.insert(doc, at, short)
    # documents are in order: sort the hashes within each by their leading bits
    order = np.argsort((doc.astype(U) << U(40)) | (found >> U(24))) if len(w.first) <= 1 << 24 else np.lexsort((found, doc))
    near = (found[order][1:] ^ found[order][:-1]) >> U(24) == 0
    if (near & (found[order][1:] != found[order][:-1]) & (doc[order][1:] == doc[order][:-1])).any():  # the leading bits don't tell them apart
        order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return found[at], doc[at], np.diff(at, append=len(found))


def sketches(g: np.ndarray, doc: np.ndarray, tf: np.ndarray, share: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: BINS / 16 words of 16 nibbles (for each bin of hashes a trace, 1 to 15, of the smallest; 0 for
    none), the number of elements that were kept, and of all.

    Elements are (shingle, occurrence), kept with probability share.  g is in order within each document.
    """
    least = np.full(m * BINS, np.iinfo(U).max, U)
    kept = np.zeros(m, np.int64)

    def place(h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return d * BINS + (h >> U(65 - BINS.bit_length())).astype(np.int64)

    def draw(h: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (w >= 1) | ((_text.mix(h ^ U(0x5851F42D4C957F2D)) >> U(11)) * 2.0**-53 < w)

    on = draw(g, share)
    h, d = (g, doc) if on.all() else (g[on], doc[on])
    kept += np.bincount(d, minlength=m)
    at = place(h, d)
    head = np.ones(len(h), bool)
    head[1:] = at[1:] != at[:-1]
    least[at[head]] = h[head]
    again = np.flatnonzero(tf > 1)
    if len(again):
        times = tf[again] - 1
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1
        h = _text.mix(np.repeat(g[again], times) + nth.astype(U) * U(0xC2B2AE3D27D4EB4F))
        on = draw(h, np.repeat(share[again], times))
        h, d = h[on], np.repeat(doc[again], times)[on]
        kept += np.bincount(d, minlength=m)
        np.minimum.at(least, place(h, d), h)
    out = np.where(least != np.iinfo(U).max, _text.mix(least) % U(15) + U(1), U(0))
    packed = (out.reshape(m, BINS // 16, 16) << (U(4) * np.arange(16, dtype=U))).sum(axis=2, dtype=U)
    return packed, kept, np.bincount(doc, tf, m)


def _alike(x: str, y: str, threshold: float, sigmas: float) -> Column:
    """Whether the sketches of two texts allow a similarity of ``threshold``, but for some standard deviations.

    At similarity J the union has u = (nx + ny) / (1 + J) kept elements that fill f bins; of these a share
    14 / 15 (1 - J) differs.  f of all elements of the union are drawn without replacement, which narrows the spread.
    """
    nibbles = F.lit(0x1111111111111111)

    def unequal(i: int) -> Column:
        d = F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))
        two = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(two.bitwiseOR(F.shiftrightunsigned(two, 2)).bitwiseAND(nibbles))

    other = sum((unequal(i) for i in range(1, BINS // 16)), unequal(0))
    f = BINS * (1 - F.exp(-(F.col(f"{x}.kept") + F.col(f"{y}.kept")) / (BINS * (1 + threshold))))
    drawn = F.least(F.lit(1.0), f * (1 + threshold) / (F.col(f"{x}.elements") + F.col(f"{y}.elements")))
    spread = F.sqrt(f * (threshold * (1 - threshold) * (1 - drawn) + 0.0125) + 0.2 * (1 - threshold) ** 2 * f)
    return other <= f * (14 / 15 * (1 - threshold)) + sigmas * spread + 1


def _allowed(common: Column, x: str, y: str, threshold: float) -> Column:
    """Whether two texts that share at most ``common`` can be alike; the sums' last digits may be off."""
    return common * (1 + threshold) >= (F.col(f"{x}.total") + F.col(f"{y}.total")) * (threshold * (1 - 1e-5))


def _rare(x: str, y: str, threshold: float) -> Column:
    """Whether each text has enough of shingles that another row has too."""
    return _allowed(F.least(F.col(f"{x}.shared"), F.col(f"{y}.shared")), x, y, threshold)


def _close(x: str, y: str, threshold: float) -> Column:
    """Whether the weights of the classes of shingles let two texts share enough."""
    least = F.zip_with(F.col(f"{x}.shares"), F.col(f"{y}.shares"), lambda p, q: F.least(p, q))
    return _allowed(F.aggregate(least, F.lit(0.0), lambda s, v: s + v), x, y, threshold)


_tables: list[np.ndarray] = []


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) quantiles at (i + 0.5) / 65536, and their logarithms."""
    if not _tables:
        q = (np.arange(65536) + 0.5) / 65536
        lo, hi = np.zeros(65536), np.full(65536, 40.0)
        for _ in range(60):
            x = (lo + hi) / 2
            below = 1 - (1 + x) * np.exp(-x) < q
            lo, hi = np.where(below, x, lo), np.where(below, hi, x)
        _tables.extend([hi, np.log(hi)])
    return _tables[0], _tables[1]


def samples(g: np.ndarray, doc: np.ndarray, weight: np.ndarray, m: int, count: int) -> np.ndarray:
    """(m, count) consistent weighted samples as hashes; rows of documents without shingles are 0."""
    gamma, log_gamma = _quantiles()
    out = np.zeros((m, count), U)
    if not len(g):
        return out
    sizes = np.bincount(doc, minlength=m)
    have = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[have]
    weighted = np.flatnonzero(weight != 1)
    logs = np.log(weight[weighted])
    low = U(0xFFFF)
    for j in range(count):
        x = g ^ _text.mix(np.array([j + 1], U) * U(0x9E3779B97F4A7C15))
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(31)
        x *= U(0x9FB21C651E98DF25)
        r = gamma[(x >> U(32)) & low]
        beta = ((x >> U(16)) & low).astype(np.float64)
        beta *= 1 / 65536
        step = 1 - beta
        t = None
        if len(weighted):
            t = np.zeros(len(g))
            t[weighted] = np.floor(logs / r[weighted] + beta[weighted])
            step += t
        a = log_gamma[x >> U(48)]
        a -= r * step
        least = np.minimum.reduceat(a, begin)
        at = np.flatnonzero(a == np.repeat(least, sizes[have]))[::-1]
        pick = np.zeros(m, np.int64)
        pick[doc[at]] = at
        pick = pick[have]
        s = g[pick] if t is None else g[pick] + t[pick].astype(np.int64).view(U) * U(0xC2B2AE3D27D4EB4F)
        out[have, j] = _text.mix(s + U(j))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts a block's name before each row: a run of rows of about BLOCK_BYTES of texts."""
    name, filled = secrets.randbits(62), 0
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = filled + np.cumsum(size) - size
        filled += int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array(name + before // BLOCK_BYTES), *batch.columns], ["block", *batch.schema.names])


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that hold values[: ends[0]], values[ends[0] : ends[1]] and so on."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _unpacked(column: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values that the binary values hold, and how many each one holds."""
    data = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    if not len(data):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    raw = data.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[data.offset : data.offset + len(data) + 1]
    held = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return np.frombuffer(held.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows that agree in the first column and follow each other; a run that goes on in the next batch comes in pieces."""
    for batch in batches:
        x = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
        yield from ((int(x[i]), batch.slice(i, j - i)) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if i < j)


def _counts(k: int):
    """Of each block, or of what a task has of it: its distinct shingles by range, and how many documents have them."""

    def flush(block: int, found: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        part = (keys >> U(65 - PARTS.bit_length())).astype(np.int64)
        ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)) if len(part) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), block, np.int64)), pa.array(part[ends - 1]), _packed(keys, ends), _packed(counts.astype(np.uint32), ends)], ["block", "part", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for block, rows in _runs(batches):
            if found and block != now:
                yield flush(now, found)
                found = []
            now = block
            found.extend(shingles(w, k)[0] for _, _, w in _text.word_blocks(rows.column(1)))
        if found:
            yield flush(now, found)

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ranges in order: to each block its shingles that more than one row has, and their document frequencies."""

    def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        keys, sizes = _unpacked(table["keys"], U)
        counts = _unpacked(table["counts"], np.uint32)[0].astype(np.int64)
        order = np.argsort(keys)
        inner = keys[order]
        first = np.flatnonzero(np.append(True, inner[1:] != inner[:-1]))
        df = np.empty(len(keys), np.int64)
        df[order] = np.repeat(np.add.reduceat(counts[order], first), np.diff(first, append=len(keys)))
        many = df > 1
        ends = np.cumsum(np.add.reduceat(many, np.cumsum(sizes) - sizes, dtype=np.int64))
        return pa.RecordBatch.from_arrays([table["block"].combine_chunks(), _packed(keys[many], ends), _packed(df[many], ends)], ["block", "keys", "df"])

    now, held = None, []
    for part, rows in _runs(batches):
        if held and part != now:
            yield flush(held)
            held = []
        now = part
        held.append(rows)
    if held:
        yield flush(held)


def _lists(x: np.ndarray) -> pa.Array:
    """The rows of x."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))


def _sketch(n: int, hot: float | None, bands: int, rows: int, k: int):
    """Samples and sketches of a block's documents, and the document frequencies of their distinct shingles in order."""
    kinds = [("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("sig", pa.list_(pa.int64())), ("bins", pa.list_(pa.int64())), ("kept", pa.float64()), ("elements", pa.float64()), ("total", pa.float64()), ("shared", pa.float64()), ("shares", pa.list_(pa.float32())), ("df", pa.binary())]
    schema = pa.schema(kinds)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys, values = _unpacked(answers["keys"], U)[0], _unpacked(answers["df"], np.int64)[0]
        order = np.argsort(keys)
        known = Frequencies(keys[order], values[order])
        out = []
        for i, j, w in _text.word_blocks(docs["text"]):
            g, doc, tf = shingles(w, k)
            m = j - i
            df = known.of(g)
            share = idf(df, n, hot)
            keep = np.flatnonzero(w.counts() > 0)
            bins, kept, elements = sketches(g, doc, tf, share, m)
            weight, many = tf * share, df > 1
            shares = np.bincount(doc[many] * SHARES + (g[many] % U(SHARES)).astype(np.int64), weight[many], m * SHARES).reshape(m, SHARES)
            sums = (kept, elements, np.bincount(doc, weight, m), shares.sum(axis=1))
            lists = [_lists(x[keep]) for x in (_text.signed(samples(g, doc, weight, m, rows * bands)), _text.signed(bins), shares.astype(np.float32))]
            names = (docs[c].slice(i, m).combine_chunks().take(pa.array(keep)) for c in ("doc_id", "t1", "t2"))
            ends = np.searchsorted(doc, keep, "right")
            out.append(pa.RecordBatch.from_arrays([*names, *lists[:2], *(pa.array(x[keep].astype(float)) for x in sums), lists[2], _packed(np.minimum(df, 0xFFFFFFFF).astype(np.uint32), ends)], schema=schema))
        return pa.Table.from_batches(out, schema)

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted distinct shingles, weights)."""
    common, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][x], b[1][y]).sum() if len(common) else 0.0
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 0.0


def _verify(n: int, hot: float | None, k: int):
    def sets(texts: pa.Array, dfs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j, w in _text.word_blocks(texts):
            g, doc, tf = shingles(w, k)
            weight = tf * idf(_unpacked(dfs.slice(i, j - i), np.uint32)[0].astype(np.int64), n, hot)
            at = np.searchsorted(doc, np.arange(j - i + 1))
            yield from ((g[p:q], weight[p:q]) for p, q in zip(at[:-1], at[1:], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, text_a, text_b, df_a, df_b = batch.columns
            j = np.array([similarity(x, y) for x, y in zip(sets(text_a, df_a), sets(text_b, df_b), strict=True)], float)
            yield pa.RecordBatch.from_arrays([a, b, pa.array(j)], ["a", "b", "similarity"])

    return run


def _joined(classes: DataFrame, over: DataFrame) -> DataFrame:
    """(node, comp): classes whose components are joined as over, the components of components, says; nodes new in over come in."""
    up = over.select(F.col("node").alias("from"), F.col("comp").alias("to"))
    risen = classes.join(up, classes["comp"] == up["from"], "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return risen.union(over.join(classes.select("node"), "node", "left_anti").select("node", "comp"))


class Found(NamedTuple):
    documents: DataFrame  # doc_id, rep: the smallest doc_id of the same text
    links: DataFrame  # a, b, similarity: verified, between representatives
    classes: DataFrame  # node, comp


class _Search:
    """The steps of ``search``; tables that later steps read are written, so lost executors cost one step."""

    def __init__(self, docs: DataFrame, threshold: float, bands: int, rows: int, hot: float | None, k: int, sigmas: float | None):
        self.scratch = Scratch(docs.sparkSession)
        self.threshold, self.bands, self.rows, self.k, self.sigmas = threshold, bands, rows, k, sigmas
        self.hot, self.n = hot, docs.count()
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
        self.blocks = self.scratch.put(texts.mapInArrow(_blocks, "block bigint, doc_id bigint, text string"), "blocks")
        self.keyed = self.blocks.where("doc_id is not null").select("block", "doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"), "text")

    def nodes(self) -> tuple[DataFrame, DataFrame]:
        """One row per text, named by its smallest doc_id, with its samples and sketch; and which document has which text."""
        put = self.scratch.put
        counts = self.blocks.select("block", "text").mapInArrow(_counts(self.k), "block bigint, part bigint, keys binary, counts binary")
        ranges = counts.select("part", "block", "keys", "counts").repartition("part").sortWithinPartitions("part")
        answers = put(ranges.mapInArrow(_answers, "block bigint, keys binary, df binary").where("length(keys) > 0"), "answers")
        weigh = _sketch(self.n, self.hot, self.bands, self.rows, self.k)
        sketch = self.keyed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(weigh, "doc_id bigint, t1 bigint, t2 bigint, sig array<bigint>, bins array<bigint>, kept double, elements double, total double, shared double, shares array<float>, df binary")
        keys = [F.xxhash64(F.lit(b), *(F.col("sig")[self.rows * b + r] for r in range(self.rows))) for b in range(self.bands)]
        self.sketch = sketch = put(sketch.withColumn("sig", F.array(*keys)).withColumnRenamed("sig", "keys"), "sketch")
        self.scratch.drop(answers)
        nodes = put(sketch.groupBy("t1", "t2").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("keys", "bins", *CARD))), "nodes")
        reps = nodes.select("t1", "t2", F.col("node").alias("rep"))
        same = put(sketch.select("doc_id", "t1", "t2").join(reps, ["t1", "t2"]).select("doc_id", "rep", (F.col("doc_id") == F.col("rep")).alias("lead")).distinct(), "same")
        return nodes, same

    def buckets(self, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Members (key, band, node, n, score) of buckets with two nodes at least, the buckets' leaders (key, heads), and
        the sketches of members."""
        put = self.scratch.put
        rungs = nodes.select("node", F.posexplode("keys").alias("band", "key"))
        sizes = put(rungs.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key", "n"), "sizes")
        members = put(rungs.join(sizes, "key").select("key", "band", "node", "n"), "members")
        score = members.groupBy("node").agg(F.sum("n").alias("score"))
        place = F.struct("score", F.xxhash64(F.lit(3), "node").alias("h"), "node")
        turn = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(LEADERS))
        first = [F.max(F.when(turn == c, place)).alias(f"l{c}") for c in range(LEADERS)]
        heads = F.transform(F.array_sort(F.array_compact(F.array(*(F.col(f"l{c}") for c in range(LEADERS)))), lambda p, q: F.when(p > q, -1).when(p < q, 1).otherwise(0)), lambda x: x["node"])
        leaders = put(members.join(score, "node").groupBy("key").agg(*first).select("key", heads.alias("heads")), "leaders")
        met = sieve(members, F.xxhash64("node"))
        cards = sifted(nodes, F.xxhash64("node"), met).select("node", *CARD, *(F.col("bins")[i].alias(f"s{i}") for i in range(BINS // 16)), *(F.col("keys")[b].alias(f"k{b}") for b in range(self.bands)))
        cards = put(cards, "cards")
        return members, leaders, cards.select("node", "shares", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cards.columns if c not in ("node", "shares")))  # never null: shorter code in joins

    def rare(self, x: str, y: str) -> Column:
        return F.lit(True) if self.sigmas is None else _rare(x, y, self.threshold)

    def alike(self, x: str, y: str) -> Column:
        return F.lit(True) if self.sigmas is None else _alike(x, y, self.threshold, self.sigmas) & _close(x, y, self.threshold)

    def led(self, members: DataFrame, leaders: DataFrame, cards: DataFrame) -> DataFrame:
        """(a, b): members and their buckets' leaders, each pair once, where sketches and bounds allow a link."""
        each = members.join(leaders, "key").select("node", F.explode("heads").alias("head")).where("node <> head")
        pairs = each.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
        bins = cards.select("node", *CARD, *(f"s{i}" for i in range(BINS // 16)))
        x, y = bins.alias("x"), bins.alias("y")
        return pairs.join(x, F.col("a") == F.col("x.node")).join(y, (F.col("b") == F.col("y.node")) & self.rare("x", "y") & self.alike("x", "y")).select("a", "b")

    def rest(self, members: DataFrame, leaders: DataFrame, cards: DataFrame, classes: DataFrame) -> DataFrame:
        """(a, b, ca, cb): of buckets that still have several components, all pairs that sketches and bounds allow."""
        put, none = self.scratch.put, F.lit(0)
        comps = classes.select(F.col("node").alias("of"), "comp")
        main = leaders.select("key", F.col("heads")[0].alias("head")).join(comps, F.col("head") == F.col("of"), "left").select("key", F.coalesce("comp", "head").alias("main"))
        here = members.where(F.col("n") > 2).join(comps, F.col("node") == F.col("of"), "left").select("key", "band", "node", "n", F.coalesce("comp", "node").alias("comp"))
        here = put(here.join(main, "key").withColumn("apart", F.col("comp") != F.col("main")).drop("main"), "here")
        still = put(here.where("apart").groupBy("key").agg(F.count("*").alias("s")), "still")
        here = here.join(still, "key").join(cards, "node")
        blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        block = lambda c: F.pmod(F.xxhash64(F.lit(9), "node"), blocks(c)).cast("int")
        here = put(here.withColumn("bx", block("s")).withColumn("by", block("n")), "open")
        x = here.where("apart").withColumn("by", F.explode(F.sequence(none, blocks("n") - 1))).alias("x")
        y = here.withColumn("bx", F.explode(F.sequence(none, blocks("s") - 1))).alias("y")
        # two that are apart meet once, and two texts in the first band that they share
        first = sum((((F.col("x.band") > b) & (F.col(f"x.k{b}") == F.col(f"y.k{b}"))).cast("int") for b in range(self.bands - 1)), none) == 0
        once = (F.col("x.comp") != F.col("y.comp")) & (~F.col("y.apart") | (F.col("x.node") < F.col("y.node")))
        same = (F.col("x.key") == F.col("y.key")) & (F.col("x.bx") == F.col("y.bx")) & (F.col("x.by") == F.col("y.by"))
        pairs = x.join(y, same & once & self.rare("x", "y") & first & self.alike("x", "y"))
        return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.least("x.comp", "y.comp").alias("ca"), F.greatest("x.comp", "y.comp").alias("cb")).distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the pairs that are links; each of a node's texts is compared."""
        met = sieve(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), F.xxhash64("node"))
        place = ("doc_id", "t1", "t2")
        texts = sifted(self.keyed, F.xxhash64("doc_id"), met).groupBy(*place).agg(F.first("text").alias("text"))
        dfs = sifted(self.sketch, F.xxhash64("doc_id"), met).groupBy(*place).agg(F.first("df").alias("df"))
        texts = self.scratch.put(texts.join(dfs, list(place)).select(F.col("doc_id").alias("node"), "text", "df"), "texts")
        text = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"), F.col("df").alias(f"df_{c}"))
        both = pairs.select("a", "b").join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b", "df_a", "df_b")
        found = both.mapInArrow(_verify(self.n, self.hot, self.k), "a bigint, b bigint, similarity double").where(F.col("similarity") >= self.threshold)
        return self.scratch.put(found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "links")


def search(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, hot: float | None = None, k: int = WORDS, sigmas: float | None = SIGMAS) -> Found:
    at = _Search(docs, threshold, bands, rows, hot, k, sigmas)
    put = at.scratch.put
    nodes, same = at.nodes()
    members, leaders, cards = at.buckets(nodes)
    at.scratch.drop(nodes)
    links = at.verified(put(at.led(members, leaders, cards), "pairs"))
    classes = put(components(links.select("a", "b"), at.scratch), "classes")
    more = put(at.rest(members, leaders, cards, classes), "pairs")
    if not more.isEmpty():
        late = at.verified(more)
        links = links.union(late)
        if not late.isEmpty():
            over = more.join(late.select("a", "b"), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
            classes = put(_joined(classes, components(over, at.scratch)), "classes")
    at.scratch.drop(at.sketch, at.blocks)
    documents = same.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    # rows of one doc_id with different texts tie those texts together
    ties = same.where("doc_id <> rep").join(same.where("lead").select("doc_id").distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    if not ties.isEmpty():
        classes = components(links.select("a", "b").union(ties), at.scratch)
    return Found(documents, links, classes)


def classes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class)."""
    found = search(docs, **options)
    known = found.documents.join(found.classes, F.col("rep") == F.col("node"), "left")
    everyone = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    named = known.select(F.col("doc_id").alias("id"), F.coalesce("comp", "rep").alias("class_id"))
    return everyone.join(named, everyone["doc_id"] == named["id"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
