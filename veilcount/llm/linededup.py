"""Line dedup by a suffix array over line-ID sequences. DataFrame functions only.

A document is the sequence of its lines that hold a word, each an ID: the place of
the trimmed line's hash in the sorted order of all lines' hashes.  A maximal run of
lines that also stands earlier (smaller doc_id, or the same document further up) is a
repeat when it has at least ``least`` lines, or at least ``chars`` characters (of
trimmed lines); every line of it but those of the first copy goes.  ``chars=None``
leaves shorter runs alone, however long their lines.

Method: prefix doubling.  rank_h orders suffixes by their first h lines; rank_2h
orders the pairs (rank_h(i), rank_h(i + h)), and the last step overlaps to reach
``least`` exactly.  Suffixes of equal rank_h are an LCP interval: their longest common
prefix is at least h lines, its first suffix is the copy that stays, and the others are
later copies of those h lines.  A run of ``least`` lines or more is the union of its
intervals of depth ``least``, a shorter one is an interval of its own length, so
deletion depends on the intervals of depths 1, 2, ... up to ``least`` alone and doubling
stops there (with ``least`` over 3, ``chars`` is held against runs of 1, 2, 4, ... lines).
Adjoining and overlapping members grow into maximal spans.  Suffixes whose rank is
unique take no part in later steps.

Scale: text is hashed to lines where it is read; only two longs a line are dealt out.
Ranks are global without a global sort: distinct keys go to range buckets by their
approximate place (exact in order, about ``PER_BUCKET`` rows each), are summed up
there, and bucket totals are summed up in two levels.  Groups are reduced by partial
aggregation and joined back; a line that a third of all documents have is one key of
an aggregation.  Text is dealt out, by document, only where a document has a span: a
bitmap of fixed size sorts most others out where they are read.

Defined cases: null text stays null with no lines, empty and blank lines are not part
of the sequence and go only within a deleted run; rows of one doc_id with the same
text count as one document; ties of order cannot be, as (doc_id, hash of the text,
place) names a line; null doc_id orders last; a very long text is one array of lines in
one row; an empty table gives an empty result; other columns are carried along whatever
their names, but one called __vc_spans is in the way of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilcount.llm._scratch import Scratch, free
from veilcount.llm._sieve import marked, sieve

LEAST, CHARS, PER_BUCKET, PER_BLOCK = 3, 20, 100_000, 1024
#: White space that does not make a word.
BLANKS = " \t\n\u000b\f\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _sequence(docs: DataFrame, text: str) -> DataFrame:
    """(d, k, pos, line, h1, h2, chars) per line with a word: document, hash of its text, place in the sequence, place in the text."""
    cut = F.transform(_lines(F.col(text)), lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(BLANKS)).alias("s")))
    worded = F.filter(cut, lambda x: x["s"] != "")
    hashed = F.transform(worded, lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["s"]).alias("h1"), F.xxhash64(F.lit(1), x["s"]).alias("h2"), F.length(x["s"]).cast("bigint").alias("chars")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("d"), F.xxhash64(text).alias("k"), F.posexplode(hashed).alias("pos", "x"))
    return rows.select("d", "k", "pos", "x.line", "x.h1", "x.h2", "x.chars")


def _ranked(keys: DataFrame, approx: Column, total: int, scratch: Scratch) -> DataFrame:
    """keys: distinct (a, b, n).  (a, b, rank): how many rows stand before the key in the order of (a, b).

    approx grows with (a, b) and lies in [0, 1); it deals the keys to range buckets.
    """
    buckets = max(1, total // PER_BUCKET)
    dealt = keys.withColumn("bucket", F.least(F.floor(approx * buckets), F.lit(buckets - 1)).cast("bigint"))
    inside = dealt.withColumn("before", F.sum("n").over(W.partitionBy("bucket").orderBy("a", "b")) - F.col("n"))
    inside = scratch.put(inside, "ranks")
    if buckets == 1:
        return inside.select("a", "b", F.col("before").alias("rank"))
    sums = inside.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("bucket") / PER_BLOCK))
    blocks = sums.groupBy("block").agg(F.sum("n").alias("n"))  # one row for PER_BUCKET x PER_BLOCK keys
    start = blocks.select("block", (F.sum("n").over(W.orderBy("block")) - F.col("n")).alias("start"))
    within = sums.select("bucket", "block", (F.sum("n").over(W.partitionBy("block").orderBy("bucket")) - F.col("n")).alias("within"))
    offset = within.join(start, "block").select("bucket", (F.col("start") + F.col("within")).alias("offset"))
    return inside.join(offset, "bucket").select("a", "b", (F.col("offset") + F.col("before")).alias("rank"))


def suffixes(docs: DataFrame, scratch: Scratch, least: int = LEAST, text: str = "text") -> Iterator[tuple[int, DataFrame]]:
    """(h, table) for h = 1, 2, 4, ..., least (2 at least).  Table: (d, k, pos, line, last, chars, rank) of the suffixes that share
    their first h lines with another; last is the line that prefix ends on, chars its characters."""
    rows = scratch.put(_sequence(docs, text).distinct(), "lines")
    keys = rows.groupBy(F.col("h1").alias("a"), F.col("h2").alias("b")).agg(F.count("*").alias("n")).where("n > 1")
    keys = scratch.put(keys, "keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    unit = F.col("a").cast("double") / F.lit(2.0**64) + 0.5
    ranks = _ranked(keys, unit, total, scratch)
    active = rows.join(ranks, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")))
    active = scratch.put(active.select("d", "k", "pos", "line", F.col("line").alias("last"), "chars", "rank"), "suffixes")
    scratch.drop(rows)
    have = 1
    yield have, active
    here = W.partitionBy("d", "k").orderBy("pos")
    depth = max(least, 2)  # of two lines, for the blank lines between them
    while have < depth:
        step = min(have, depth - have)
        then = lambda c, s=step: F.lead(c, s).over(here)
        chars = F.col("chars") + then("chars") if step == have else then("chars")  # where prefixes overlap, those of the later part
        pairs = active.select("d", "k", "pos", "line", then("last").alias("last"), chars.alias("chars"), F.col("rank").alias("a"), then("rank").alias("b"), (then("pos") - F.col("pos")).alias("gap")).where(F.col("gap") == step).drop("gap")
        pairs = scratch.put(pairs, "pairs")
        keys = scratch.put(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "keys")
        groups = keys.groupBy("a").agg(F.sum("n").alias("of"))
        placed = keys.join(groups.withColumnRenamed("a", "a_"), F.col("a") == F.col("a_")).where("n > 1")
        top = F.lit(float(max(total, 1)))
        # the place of (a, b): after all smaller a, and within a group of a by the share of b
        ranks = _ranked(placed.select("a", "b", "n", "of"), (F.col("a") + F.col("of") * (F.col("b") / (top + 1))) / (top + 1), total, scratch)
        active = scratch.put(pairs.join(ranks, ["a", "b"]).select("d", "k", "pos", "line", "last", "chars", "rank"), "suffixes")
        have += step
        yield have, active


def runs(docs: DataFrame, scratch: Scratch, least: int = LEAST, chars: int | None = CHARS, text: str = "text") -> DataFrame:
    """(d, k, spans): per document the maximal spans of lines to delete, as sorted structs (first, last)."""
    place = lambda: F.struct(F.col("d").isNull().alias("o"), F.col("d"), F.col("k"), F.col("pos"))
    later = None
    for have, found in suffixes(docs, scratch, least, text):
        if have < least:
            if chars is None:
                continue
            found = found.where(F.col("chars") >= chars)
        first = found.groupBy("rank").agg(F.min(place()).alias("home"))
        part = found.join(first, "rank").where(place() > F.col("home")).select("d", "k", "line", "last")
        later = part if later is None else later.union(part)
    w = W.partitionBy("d", "k").orderBy("line")
    reach = F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1))
    islands = later.withColumn("new", F.when(F.col("line") <= reach + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    spans = islands.groupBy("d", "k", "island").agg(F.min("line").alias("first"), F.max("last").alias("last"))
    return scratch.put(spans.groupBy("d", "k").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")), "spans")


def dedup(docs: DataFrame, least: int = LEAST, chars: int | None = CHARS, text: str = "text") -> DataFrame:
    """docs with ``text`` shortened, and the column __vc_spans: the deleted spans of lines (null: none)."""
    scratch = Scratch(docs.sparkSession)
    spans = runs(docs, scratch, least, chars, text)
    bits = sieve(spans, F.xxhash64(F.lit(2), "d", "k"))
    d, k, held, e, h = free(docs, "__vc_d", "__vc_k", "__vc_held", "__vc_e", "__vc_h")
    keyed = docs.withColumn(d, F.col("doc_id").cast("bigint")).withColumn(k, F.xxhash64(text))
    keyed = marked(keyed, F.xxhash64(F.lit(2), d, k), bits, held)
    whole = keyed.where(~F.col(held)).withColumn("__vc_spans", F.lit(None).cast(spans.schema["spans"].dataType))
    named = spans.select(F.col("d").alias(e), F.col("k").alias(h), F.col("spans").alias("__vc_spans"))
    joined = keyed.where(held).join(named, F.col(d).eqNullSafe(F.col(e)) & (F.col(k) == F.col(h)), "left")
    lines, cut = _lines(F.col(text)), F.col("__vc_spans")
    begin = F.concat(F.array(F.lit(0)), F.transform(cut, lambda s: s["last"] + 1))
    end = F.concat(F.transform(cut, lambda s: s["first"]), F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.arrays_zip(begin.alias("b"), end.alias("e")), lambda g: F.slice(lines, g["b"] + 1, g["e"] - g["b"])))
    joined = joined.withColumn(text, F.when(cut.isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    return whole.select(*docs.columns, "__vc_spans").union(joined.select(*docs.columns, "__vc_spans"))
