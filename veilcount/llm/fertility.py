"""Quality rules on words and on tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated five-word windows.
Fertility rules measure two public vocabularies on the text, pieces with byte fallback
and byte-level merges for many languages: characters per token, share of tokens that
are bytes (of a character that the vocabulary lacks, or parts of one) and entropy of
the token distribution.  Each measure is held against a band of the documents of the
same language, or of the same script where no language is given (the script of most of
the text's letters), and of similar length: the entropy of a text depends on its
length, so length classes are powers of two of the token count.  Bands come from exact
quantiles of binned measures over all documents, by grouped aggregation; what is sent
on is bounded by languages x length classes x bins.

A measure is rejected outside [q50 - spread (q50 - q25) - slack, q50 + spread (q75 - q50) + slack].
Quartiles do not move while less than a quarter of a class is junk on one side, so junk does not set its own band.
Every class has a band: to its own documents come ``least`` more, spread as those of its language, nearest lengths
first (a weight of 1/2 for each power of two apart), and to these in turn ``least`` spread as those of all languages.

Defined cases: null or empty text has no words and fails the base rules; a null or blank
language is the script's class (``script:und`` for a text without letters); a very long
text counts as a whole; a measure on the edge of its band is kept; repeated rows are
judged alike; an empty table gives an empty result; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilcount.llm import _text
from veilcount.llm._chunks import ChunkIds, joined
from veilcount.llm._scratch import Scratch

MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
SPREAD, LEAST = 4.0, 50
#: (measure, bin width, slack): a band is never narrower than the slack on either side; of each vocabulary in turn.
KINDS = (("chars_per_token", 0.01, 0.05), ("byte_share", 0.0025, 0.01), ("token_entropy", 0.02, 0.1))
VOCABULARIES = ("", "_2")
MEASURES = tuple((m + v, width, slack) for v in VOCABULARIES for m, width, slack in KINDS)
SCHEMA = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, " + ", ".join(f"n_tokens{v} bigint, chars_per_token{v} double, byte_share{v} double, token_entropy{v} double" for v in VOCABULARIES)

# Scripts by the first byte of a character's UTF-8 form.
SCRIPTS = {"latn": (0xC3, 0xC9), "grek": (0xCE, 0xCF), "cyrl": (0xD0, 0xD3), "armn": (0xD4, 0xD5), "hebr": (0xD6, 0xD7), "arab": (0xD8, 0xDB), "indc": (0xE0, 0xE0), "mong": (0xE1, 0xE1), "kana": (0xE3, 0xE3), "hani": (0xE4, 0xE9), "hang": (0xEA, 0xED), "und": (0, 0)}
_caches: dict[str, tuple] = {}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


_SCRIPT = np.full(256, len(SCRIPTS) - 1, np.uint8)
for _n, (_a, _b) in enumerate(SCRIPTS.values()):
    if _a:
        _SCRIPT[_a : _b + 1] = _n
_SCRIPT[[c for c in range(0x80) if chr(c).isalpha()]] = 0


def scripts(w: _text.Words) -> list[str]:
    """The script of most letters of each document of a block."""
    names, m = list(SCRIPTS), len(w.first) - 1
    kind = _SCRIPT[w.buf]
    counts = np.stack([_sums(kind == k, w.offsets) for k in range(len(names) - 1)])
    best = np.where(counts.max(axis=0, initial=0) > 0, counts.argmax(axis=0), len(names) - 1) if m else []
    return [names[k] for k in best]


def _vocabularies(paths: tuple[str, str]) -> tuple[ChunkIds, list[np.ndarray]]:
    """Ids of chunks and which ids are bytes, under a model of pieces and a table of ranks."""
    if paths not in _caches:
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        p = sentencepiece.SentencePieceProcessor(model_file=paths[0])
        skip = len(p.encode("\n"))  # the dummy prefix and the line end, which joins with nothing
        with open(paths[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        bytes_of = [np.array([p.is_byte(i) for i in range(p.vocab_size())]), np.zeros(max(ranks.values()) + 1, bool)]
        for token, i in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                bytes_of[1][i] = True
        cache = ChunkIds(lambda texts: joined([x[skip:] for x in p.encode(["\n" + x for x in texts], num_threads=1)]), lambda texts: joined([t.encode_ordinary(x) for x in texts]), most=300_000)
        _caches[paths] = cache, bytes_of
    return _caches[paths]


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def _twice(key: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    s = np.sort(key)
    again = np.unique(s[1:][s[1:] == s[:-1]])
    return np.isin(key, again, kind="sort") if len(again) else np.zeros(len(key), bool)


def base_counts(w: _text.Words, window: int = REPEAT_WINDOW) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document of a block."""
    buf, first, m = w.buf, w.first, len(w.first) - 1
    chars = ((buf & 0xC0) != 0x80) & ~_text._SEP[buf]
    salt = _text.mix(np.arange(m, dtype=_text.U) + _text.U(1))
    ends = np.flatnonzero(buf == 0x0A)
    lo = np.sort(np.concatenate([w.offsets[:-1], ends + 1]))
    hi = np.sort(np.concatenate([w.offsets[1:], ends]))
    worded = np.searchsorted(w.start, hi) > np.searchsorted(w.start, lo)
    lo, hi = lo[worded], hi[worded]
    line_doc = np.searchsorted(w.offsets, lo, "right") - 1
    key = _text.hash_spans(buf, lo, hi) ^ salt[line_doc]
    lines, at = np.unique(key, return_index=True)
    dup = np.bincount(line_doc, minlength=m) - np.bincount(line_doc[at], minlength=m)
    h = w.hashes()
    g, ok, doc = _text.grams(h, window), _text.inside(first, window), w.doc()
    twice = np.zeros(len(g), bool)
    twice[ok] = _twice(g[ok] ^ salt[doc[: len(g)][ok]])
    edge = np.zeros(len(h) + 1, np.int64)
    edge[: len(g)] += twice
    edge[window : window + len(g)] -= twice
    return {"n_words": w.counts(), "word_chars": _sums(chars, w.offsets), "n_symbols": _sums(_SYMBOL[buf], w.offsets), "n_dup_lines": dup, "n_repeat_words": _sums(np.cumsum(edge)[: len(h)] > 0, first)}


def token_measures(w: _text.Words, paths: tuple[str, str]) -> dict[str, np.ndarray]:
    """n_tokens, chars_per_token, byte_share and token_entropy (bits) of each document of a block, by vocabulary.

    A chunk is a word with the white space before it, and the white space at a document's end: tokens of
    both vocabularies hold white space only at their start, so chunks tokenise alone.
    """
    cache, bytes_of = _vocabularies(paths)
    m, n = len(w.first) - 1, len(w.buf)
    cuts = np.unique(np.concatenate([w.offsets, w.end]))
    lo, hi = cuts[:-1], cuts[1:]
    h = _text.hash_spans(w.buf, lo, hi)
    head = np.isin(lo, w.offsets)  # what pieces put a space before
    h[head] ^= _text.U(0x5851F42D4C957F2D)
    raw = w.buf.tobytes()

    def text(i: int) -> tuple[str, str]:
        x = raw[lo[i] : hi[i]].decode()
        return (" " + x if head[i] else x), x

    owner = np.searchsorted(w.offsets, lo, "right") - 1
    chars = _sums((w.buf & 0xC0) != 0x80, w.offsets) if n else np.zeros(m)
    out = {}
    for (lengths, ids), is_byte, v in zip(cache.lookup(h, text), bytes_of, VOCABULARIES, strict=True):
        doc = np.repeat(owner, lengths)
        tokens = np.bincount(doc, minlength=m)
        least = np.maximum(tokens, 1)
        key, counts = np.unique(doc * np.int64(len(is_byte)) + ids, return_counts=True)
        logs = np.bincount(key // len(is_byte), counts * np.log2(counts), m)
        out |= {f"n_tokens{v}": tokens, f"chars_per_token{v}": chars / least, f"byte_share{v}": np.bincount(doc, is_byte[ids], m) / least, f"token_entropy{v}": np.log2(least) - logs / least}
    return out


def measures(docs: DataFrame, *paths: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in _text.word_blocks(batch.column(2)):
                found = base_counts(w) | token_measures(w, paths)
                lang = batch.column(1).slice(i, j - i)
                if lang.null_count:
                    lang = pa.array([x or f"script:{y}" for x, y in zip(lang.to_pylist(), scripts(w), strict=True)])
                arrays = [batch.column(0).slice(i, j - i), lang]
                arrays += [pa.array(np.round(v, 9) if v.dtype.kind == "f" else v.astype(np.int64)) for v in found.values()]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", *found])

    lang = F.nullif(F.trim(F.col("lang").cast("string")), F.lit("")) if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"), "text").mapInArrow(run, SCHEMA)


def _classed(df: DataFrame) -> DataFrame:
    return df.withColumn("band", F.col("lang")).withColumn("size", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))


def _shrunk(bins: DataFrame, least: int) -> DataFrame:
    """bins with weights n: of the class, of its language and of all, each in proportion to the documents it has."""
    classes = bins.groupBy("band", "size", "m").agg(F.sum("n").alias("own"))
    near = F.pow(F.lit(2.0), -F.abs(F.col("size") - F.col("size_")))

    def spread_out(to: list[str]) -> DataFrame:
        """Shares of the bins at each length, from all lengths: to, size, m, bin, share."""
        by = bins.groupBy(*to, F.col("size").alias("size_"), "m", "bin").agg(F.sum("n").alias("n"))
        out = classes.select(*to, "size", "m").distinct().join(by, [*to, "m"]).groupBy(*to, "size", "m", "bin").agg(F.sum(F.col("n") * near).alias("x"))
        return out.select(*to, "size", "m", "bin", (F.col("x") / F.sum("x").over(W.partitionBy(*to, "size", "m"))).alias("share"))

    language, all_of = spread_out(["band"]), spread_out([])
    totals = classes.withColumn("total", F.sum("own").over(W.partitionBy("band", "m")))
    part = least / (F.col("total") + least)  # the part of all languages in what a class is shrunk towards
    own = bins.select("band", "size", "m", "bin", F.col("n").cast("double").alias("n"))
    from_language = totals.join(language, ["band", "size", "m"]).select("band", "size", "m", "bin", (least * (1 - part) * F.col("share")).alias("n"))
    from_all = totals.join(all_of, ["size", "m"]).select("band", "size", "m", "bin", (least * part * F.col("share")).alias("n"))
    return own.union(from_language).union(from_all).groupBy("band", "size", "m", "bin").agg(F.round(F.sum("n"), 6).alias("n"))


def bands(measured: DataFrame, spread: float = SPREAD, least: int = LEAST) -> DataFrame:
    """One row per language and length class: low and high of each measure."""
    usable = _classed(measured).where("not base_failed")
    long = usable.select("band", "size", F.explode(F.array(*(F.struct(F.lit(k).alias("m"), F.floor(F.col(m) / width + 0.5).cast("int").alias("bin")) for k, (m, width, _) in enumerate(MEASURES)))).alias("x"))
    bins = _shrunk(Scratch(measured.sparkSession).put(long.groupBy("band", "size", "x.m", "x.bin").agg(F.count("*").alias("n")), "bins"), least)
    w = W.partitionBy("band", "size", "m").orderBy("bin")
    ranked = bins.withColumn("upto", F.sum("n").over(w)).withColumn("of", F.sum("n").over(W.partitionBy("band", "size", "m")))
    q = lambda p: F.min(F.when(F.col("upto") >= F.lit(p) * F.col("of"), F.col("bin")))
    cut = ranked.groupBy("band", "size", "m").agg(q(0.25).alias("a"), q(0.5).alias("b"), q(0.75).alias("c"))
    return cut.groupBy("band", "size").agg(
        *(
            F.max(F.when(F.col("m") == k, e)).alias(f"{m}_{side}")
            for k, (m, width, slack) in enumerate(MEASURES)
            for side, e in (("low", width * (F.col("b") - spread * (F.col("b") - F.col("a"))) - slack), ("high", width * (F.col("b") + spread * (F.col("c") - F.col("b"))) + slack))
        ),
    )


def judge(docs: DataFrame, *vocabularies: str, spread: float = SPREAD, least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, base counts, base_failed, kept, then its band, the fertility measures and fertility_failed.

    vocabularies: places of a model of pieces and of a table of ranks.
    """
    scratch = Scratch(docs.sparkSession)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    measured = scratch.put(measures(docs, *vocabularies).withColumn("base_failed", failed), "measures")
    band = scratch.put(bands(measured, spread, least), "bands")
    joined = _classed(measured).join(band, ["band", "size"], "left")
    out = F.lit(False)
    for m, _, _ in MEASURES:
        out = out | F.coalesce((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(False))
    return joined.withColumn("fertility_failed", out).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("fertility_failed")).alias("kept"), F.col("lang").alias("band"), *(f"{m}{v}" for v in VOCABULARIES for m in ("n_tokens", "chars_per_token", "byte_share", "token_entropy")), "fertility_failed")
