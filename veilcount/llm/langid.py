"""Language identification by Bayesian fusion of evidence.

Three kinds of evidence are multiplied:

* text: likelihoods of byte trigrams (lower case, runs of non-letters as one space),
  trained on a sample of about ``SAMPLE`` rows with a declared language, drawn per
  language: those with fewer rows than an even share keep all of them.  Trigrams
  are not independent, so the mean log-likelihood counts as at most ``EFFECTIVE``
  observations;
* the declared language (markup or metadata): P(declared | language), estimated over
  all rows from the text's posterior;
* where the text comes from: P(language | host), smoothed in a hierarchy - host
  towards its domain, domain towards its address suffix, suffix towards the corpus -
  by grouped aggregation over all rows.  A row's own share is left out of its host.

A row is rejected when it has no letters or the posterior of its best language is
below ``MIN_CONFIDENCE``.

Languages are the ``LANGUAGES`` most frequent declared values of at least ``LEAST``
rows; rarer ones (typing errors, mostly) are no evidence, and the model, what is
collected for it and the expressions stay bounded whatever the metadata hold.

Scale: two narrow scans of the text (the sample, the likelihoods); counts by
declared language, suffix, domain and host come from partial aggregation, and go
back by equi-joins, so a host with a third of all rows is no burden.

Defined cases: null or empty text has no letters; a very long text counts as a whole;
null declared language or host is no evidence; of languages that tie the last by name
wins; repeated rows are judged alike; with no declared language at all every row is
"und" and rejected; an empty table gives an empty result; extra columns are kept by
``keep`` and otherwise ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.llm import _text
from veilcount.llm._scratch import Scratch

SAMPLE, BUCKETS, EFFECTIVE, MIN_CONFIDENCE = 20_000, 1 << 14, 60, 0.5
#: Rows of the level above that a host, domain or suffix starts with.
KAPPA = 5.0
LANGUAGES, LEAST = 64, 5
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[:0x80] = [ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(0x80)]


class Model(NamedTuple):
    languages: list[str]
    logs: np.ndarray  # (languages, buckets)


def trigrams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of each trigram within a document, without those of two spaces."""
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = _LETTER[buf]
    latin = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    x[1:][latin] += 0x20
    same = np.ones(len(x) - 2, bool)
    edges = offsets[1:-1]
    for back in (1, 2):
        e = edges - back
        same[e[(e >= 0) & (e < len(same))]] = False
    space = x == 0x20
    at = np.flatnonzero(same & ~(space[:-2] & space[1:-1]) & ~(space[1:-1] & space[2:]))
    key = x[at].astype(np.uint32) | (x[at + 1].astype(np.uint32) << 8) | (x[at + 2].astype(np.uint32) << 16)
    key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
    return key.astype(np.int64), np.searchsorted(offsets, at, "right") - 1


def _count(languages: list[str]):
    index = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            which = np.array([index.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            for i, _, buf, offsets in _text.blocks(batch.column(1)):
                key, doc = trigrams(buf, offsets)
                lang = which[i + doc]
                total += np.bincount((lang * BUCKETS + key)[lang >= 0], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["k", "n"])

    return run


def quotas(counts: dict[str, int], sample: int = SAMPLE) -> dict[str, int]:
    """Rows to draw per language: an even share (at least 5), and what small languages leave of theirs goes to the others."""
    out, left = {}, sample
    for i, (language, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[language] = min(n, max(5, left // (len(counts) - i)))
        left = max(0, left - out[language])
    return out


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """rows: text, declared.  The sample is drawn by a hash of the row, so it is the same whatever the partitioning."""
    labelled = rows.where("declared is not null and text is not null")
    frequent = labelled.groupBy("declared").count().where(F.col("count") >= LEAST).orderBy(F.desc("count"), "declared").limit(LANGUAGES)
    counts = {r["declared"]: r["count"] for r in frequent.collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    fine = 1 << 40
    limits = F.create_map(*(F.lit(x) for language, q in quotas(counts, sample).items() for x in (language, -(-q * fine // counts[language]))))
    drawn = labelled.where(F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(fine)) < F.try_element_at(limits, F.col("declared")))
    n = np.zeros(len(languages) * BUCKETS)
    for r in drawn.select("declared", "text").mapInArrow(_count(languages), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
        n[r["k"]] = r["n"]
    n = n.reshape(len(languages), BUCKETS) + 0.5
    return Model(languages, np.log(n / n.sum(axis=1, keepdims=True)))


def _likelihoods(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.languages)
        for batch in batches:
            for i, j, buf, offsets in _text.blocks(batch.column(0)):
                key, doc = trigrams(buf, offsets)
                m = j - i
                n = np.bincount(doc, minlength=m)
                mean = np.stack([np.bincount(doc, logs[key], m) for logs in model.logs], axis=1) / np.maximum(n, 1)[:, None]
                logs = mean * np.minimum(n, EFFECTIVE)[:, None]
                soft = np.exp(logs - logs.max(axis=1, keepdims=True))
                soft /= soft.sum(axis=1, keepdims=True)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * size, pa.int32()), pa.array(x.reshape(-1))) for x in (logs, soft)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, m) for c in range(1, batch.num_columns)), pa.array(n), *lists], [*batch.schema.names[1:], "n_trigrams", "logs", "soft"])

    return run


def identify(rows: DataFrame, keep: list[str], sample: int = SAMPLE, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rows: text, declared, host and the columns of ``keep``.

    One row each: ``keep``, language, confidence, declared, agrees (null without a declared language), rejected.
    """
    scratch = Scratch(rows.sparkSession)
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    host = F.lower(F.trim("host"))
    labels = F.split(host, r"\.")
    local = rows.select(
        F.col("text"),
        *named,
        F.regexp_extract(F.lower(F.trim("declared")), "^[a-z]+", 0).alias("declared"),
        host.alias("host"),
        F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host).alias("domain"),
        F.when(F.size(labels) > 1, F.element_at(labels, -1)).when(host.isNotNull(), F.lit("")).alias("suffix"),
    ).withColumn("declared", F.when(F.col("declared") != "", F.col("declared")))
    model = train(local.select("text", "declared"), sample)
    size = len(model.languages)
    kinds = [f.dataType.simpleString() for f in local.select(*(f"k{i}" for i in range(len(keep)))).schema]
    if not size:
        return local.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), "declared", F.lit(None).cast("boolean").alias("agrees"), F.lit(True).alias("rejected"))
    schema = ", ".join([*(f"k{i} {t}" for i, t in enumerate(kinds)), "declared string, host string, domain string, suffix string, n_trigrams bigint, logs array<double>, soft array<double>"])
    seen = scratch.put(local.mapInArrow(_likelihoods(model), schema), "likelihoods")
    each = range(size)
    soft = [F.when(F.col("n_trigrams") > 0, F.col("soft")[i]).otherwise(0.0) for i in each]
    known = F.col("declared").isin(model.languages)
    sums = [F.sum(soft[i]).alias(f"s{i}") for i in each]
    list_of = lambda exprs: F.array(*exprs)

    def level(key: str, above: DataFrame | None, up: str | None) -> DataFrame:
        """Smoothed language shares by key: (key, n: the weights seen, p: the shares)."""
        extra = [F.first(up).alias(up)] if up else []
        counts = seen.where(F.col(key).isNotNull()).groupBy(key).agg(*sums, *extra)
        if above is None:
            base = list_of([F.lit(1.0 / size)] * size)
        else:
            counts = counts.join(above.select(F.col(up).alias(f"{up}_"), F.col("p").alias("base")), F.col(up) == F.col(f"{up}_"), "left")
            base = F.col("base")
        n = list_of([F.col(f"s{i}") for i in each])
        total = sum((F.col(f"s{i}") for i in each), F.lit(0.0))
        share = list_of([(F.col(f"s{i}") + KAPPA * base[i]) / (total + KAPPA) for i in each])
        return counts.select(key, n.alias("n"), base.alias("base"), share.alias("p"), *([up] if up else []))

    suffixes = level("suffix", None, None)
    domains = level("domain", suffixes.select("suffix", "p"), "suffix")
    hosts = scratch.put(level("host", domains.select("domain", "p"), "domain").select(F.col("host").alias("host_"), "n", "base"), "hosts")
    said = [r.asDict() for r in seen.where(known).groupBy("declared").agg(*sums).collect()]
    table = np.full((size, size), 0.5)
    for r in said:
        table[model.languages.index(r["declared"])] += [r[f"s{i}"] or 0.0 for i in each]
    table = np.log(table / table.sum(axis=0))
    spoken = rows.sparkSession.createDataFrame([(x, table[i].tolist()) for i, x in enumerate(model.languages)], "declared_ string, spoken array<double>")
    joined = seen.join(hosts, F.col("host") == F.col("host_"), "left").join(F.broadcast(spoken), F.col("declared") == F.col("declared_"), "left")
    rest = sum((F.col("n")[i] - soft[i] for i in each), F.lit(0.0))
    score = []
    for i in each:
        prior: Column = F.log(F.greatest((F.col("n")[i] - soft[i] + KAPPA * F.col("base")[i]) / (F.greatest(rest, F.lit(0.0)) + KAPPA), F.lit(1e-9)))
        declared = F.coalesce(F.col("spoken")[i], F.lit(0.0))
        score.append(F.struct((F.col("logs")[i] + declared + F.coalesce(prior, F.lit(0.0))).alias("s"), F.lit(model.languages[i]).alias("l")))
    judged = joined.withColumn("scores", F.array(*score)).withColumn("top", F.array_max("scores"))
    mass = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - F.col("top")["s"]))
    judged = judged.withColumn("confidence", F.when(F.col("n_trigrams") > 0, F.round(1 / mass, 6)).otherwise(0.0))
    judged = judged.withColumn("language", F.when(F.col("n_trigrams") > 0, F.col("top")["l"]).otherwise("und"))
    return judged.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)),
        "language",
        "confidence",
        "declared",
        (F.col("declared") == F.col("language")).alias("agrees"),
        (F.col("confidence") < min_confidence).alias("rejected"),
    )


def of_documents(docs: DataFrame) -> DataFrame:
    """documents as rows for ``identify``: lang is the declared language, source the host."""
    have = set(docs.columns)
    column = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", column("lang").alias("declared"), column("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """pages as rows for ``identify``: main text, language of the html element, host of the address."""
    from veilcount.llm.htmltext import extract

    tag = F.regexp_extract("html", r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    declared = pages.select("page_id", "url", "html", F.when(tag != "", tag).alias("declared"))
    text = extract(declared, keep=["page_id", "url", "declared"])
    return text.select("page_id", "text", "declared", F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1).alias("host")).withColumn("host", F.when(F.col("host") != "", F.col("host")))
