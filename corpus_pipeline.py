"""A corpus pipeline: documents in, packed training sequences out.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next one's docs.  All but
the last return the columns of documents.

Rows of one doc_id are one document; rows with a null doc_id are judged each on
their own and take no part in near-duplicate classes; null, empty and blank texts are
rejected with the language (they hold no letters); of repeated rows and ties the first by
doc_id stays in line and near dedup; very long texts are worked on whole; an empty table
gives an empty result; extra columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcount.llm import decontam, langid, linededup, neardup, packing
from veilcount.llm._scratch import Scratch, free
from veilcount.llm.queries import table, vocabulary


def _keyed(docs: DataFrame, n: int = 2) -> tuple[DataFrame, list[str]]:
    """docs with hashes that stand for a row's doc_id and text, and the names of these columns."""
    names = free(docs, *(f"__vc_{i}" for i in range(n)))
    return docs.select("*", *(F.xxhash64(F.lit(i), "doc_id", "text").alias(x) for i, x in enumerate(names))), names


def _without(docs: DataFrame, gone: DataFrame, names: list[str]) -> DataFrame:
    """docs but those whose keys are in gone."""
    gone = Scratch(docs.sparkSession).put(gone.distinct(), "gone")
    return _keyed(docs, len(names))[0].join(gone.toDF(*names), names, "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    names = _keyed(docs)[1]
    rows = _keyed(langid.of_documents(docs))[0].withColumnsRenamed({"__vc_0": "key0", "__vc_1": "key1"})
    return _without(docs, langid.identify(rows, ["key0", "key1"]).where("rejected").select("key0", "key1"), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of three lines or more are cut out; a document of which no word is left goes.

    Shorter repeats stay here: cut line by line, near copies would reach the next stage as remnants that are alike to
    nothing, where they now reach it whole and go as documents.
    """
    out = linededup.dedup(docs, chars=None)
    out = out.where(F.col("__vc_spans").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__vc_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the smallest doc_id stays."""
    [name] = free(docs, "__vc_0")
    gone = Scratch(spark).put(neardup.classes(docs).where("class_id <> doc_id").select(F.col("doc_id").alias(name)), "gone")
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    keyed, [name] = _keyed(docs, 1)
    leaks = decontam.leaks(keyed.select(F.col(name).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, leaks.select("doc_id"), [name])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of packed sequences."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Language identification, sampling and tokenising are beyond SQL; tests hold each operator, and the chain of stages on
#: what the one before kept, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared scratch folder and reread."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
