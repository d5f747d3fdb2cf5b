"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcount.llm import decontam, fertility, htmltext, langid, licenses, linededup, neardup, ordinal, packing, substr


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(langid.of_documents(table(spark, sf_dir, "documents")), ["doc_id"])


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(langid.of_pages(table(spark, sf_dir, "pages")), ["page_id"])


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = linededup.dedup(docs.withColumn("__vc_text", F.col("text")))
    gone = F.aggregate("__vc_spans", F.lit(0), lambda s, x: s + x["last"] - x["first"] + 1)
    return out.select(
        "doc_id",
        F.when(F.col("__vc_text").isNull(), 0).otherwise(F.size(F.split("__vc_text", "\n"))).cast("bigint").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("bigint").alias("n_deleted"),
        F.md5("text").alias("text_md5"),
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.train(docs, ordinal.grades(table(spark, sf_dir, "labels")), 3)
    out = ordinal.score(docs, model, 3)
    return out.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_ge1"), F.col("tails")[1].alias("p_ge2"), "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_multi_50k.tiktoken"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.dedup(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_language_id, langid_pages, op2_minhash_near_dedup, op3_decontamination, op4_line_dedup, op5_html_extraction, op6_quality_classifier, op7_quality_rules, op8_best_fit_packing, op9_substring_dedup, op10_license_scan)
    return {f.__name__: f for f in found}


_BLANK = "chr(32) || chr(9) || chr(11) || chr(12) || chr(13)"
_WORD = r"[^\x20\x09-\x0D]+"


def _line_dedup_sql(least: int, chars: int) -> str:
    """Windows of each length below ``least`` that carry enough characters, and all of ``least`` lines, but the first of each."""
    keys = ", ".join(f"lead(s, {i}) OVER d AS s{i}, lead(ln, {i}) OVER d AS l{i}" for i in range(1, least))
    names = ["s", *(f"s{i}" for i in range(1, least))]
    windows = []
    for n in range(1, least + 1):
        last = f"l{n - 1}" if n > 1 else "ln"
        enough = f" AND {' + '.join(f'length({x})' for x in names[:n])} >= {chars}" if n < least else ""
        windows.append(f"SELECT doc_id, ln, {last} AS last, row_number() OVER (PARTITION BY {', '.join(names[:n])} ORDER BY doc_id, ln) AS nth FROM w WHERE {last} IS NOT NULL{enough}")
    return f"""
WITH a AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS ln FROM a),
b AS (SELECT doc_id, ln, trim(line, {_BLANK}) AS s FROM l WHERE trim(line, {_BLANK}) <> ''),
w AS (SELECT doc_id, ln, s, {keys} FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY ln)),
r AS ({" UNION ALL ".join(windows)}),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(ln, last)) AS ln FROM r WHERE nth > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.ln) AS n_deleted, coalesce(string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (WHERE gone.ln IS NULL), '') AS kept
      FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.ln = l.ln GROUP BY l.doc_id)
SELECT a.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, CASE WHEN a.text IS NOT NULL THEN md5(kept) END AS text_md5
FROM a LEFT JOIN k ON k.doc_id = a.doc_id"""


def _substring_dedup_sql(least: int) -> str:
    return f"""
WITH a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM a),
g AS (SELECT doc_id, pos, string_agg(word, ' ') OVER d AS win, count(*) OVER d AS n FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {least - 1} FOLLOWING)),
f AS (SELECT win, min(doc_id) AS lo FROM g WHERE n = {least} GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT g.doc_id, unnest(generate_series(g.pos, g.pos + {least - 1})) AS pos FROM g JOIN f ON f.win = g.win WHERE g.n = {least} AND f.lo < g.doc_id),
k AS (SELECT w.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE gone.pos IS NULL), '') AS kept,
      count(*) FILTER (WHERE gone.pos IS NOT NULL AND before.pos IS NULL) AS n_repeats
      FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.pos = w.pos LEFT JOIN gone before ON before.doc_id = w.doc_id AND before.pos = w.pos - 1 GROUP BY w.doc_id)
SELECT a.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_repeats, 0) AS n_repeats
FROM a LEFT JOIN k ON k.doc_id = a.doc_id"""


def _license_scan_sql() -> str:
    """Cuts that a sentence may run across are one line feed, others two or more; then each is doubled, so that a match can take one on either side."""
    known = licenses.known_sentences()
    values = ", ".join(f"('{s}', {i})" for s, i in known.items())
    any_of = "|".join(s.replace(" ", r"(?: |\n\n)") for s in sorted(known, key=len, reverse=True))
    rest, steps, hits = "trail", [], []
    for n, (sign, name) in enumerate(licenses.ordered_rules()):
        hits.append(f"CASE WHEN contains({rest}, '{sign}') THEN '{name}' END")
        if "||" in sign:
            steps.append(f"replace({rest}, '{sign}', '|0|') AS r{n}")
            rest = f"r{n}"
    return rf"""
WITH known(s, id) AS (VALUES {values}),
c AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '((?:^|[^\p{{L}}\p{{N}}_])[vV]\.|Identifier:)[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), '([.;:!?])[\x20\x09-\x0D]+', '\1' || chr(10) || chr(10), 'g') AS cut FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(replace(cut, chr(1), chr(10))), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')) AS s FROM c),
m AS (SELECT doc_id, regexp_extract_all(chr(10) || replace(s, chr(10), chr(10) || chr(10)) || chr(10), '\n(?:{any_of})\n') AS found FROM n),
p AS (SELECT doc_id, unnest(found) AS part, generate_subscripts(found, 1) AS i FROM m),
t AS (SELECT doc_id, count(*) AS n_sentences, string_agg(id, ',' ORDER BY i) AS sentence_ids, '|' || string_agg(id, '||' ORDER BY i) || '|' AS trail
      FROM p JOIN known ON known.s = trim(regexp_replace(part, '\n+', ' ', 'g')) GROUP BY doc_id),
h AS (SELECT doc_id, n_sentences, sentence_ids, {", ".join(["trail", *steps])}, list_sort(list_distinct([{", ".join(hits)}])) AS found FROM t)
SELECT a.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(array_to_string(found, ','), '') AS licenses
FROM documents a LEFT JOIN h ON h.doc_id = a.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": _line_dedup_sql(linededup.LEAST, linededup.CHARS), "op9_substring_dedup": _substring_dedup_sql(substr.LEAST), "op10_license_scan": _license_scan_sql()}
