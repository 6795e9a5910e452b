"""Queries of the text problems (p4, p8, p9, p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspar.llm import leakage, mixing, pii, sentences
from lumenspar.session import cut, spread
from lumenspar.sources.tables import table


def _winston(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "logs").where("source = 'winston'")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    spans = cut(pii.candidate_spans(spread(pii.fields(_winston(spark, d)))), "spans")  # read to fit and to classify
    return pii.PiiFinder.fit_spans(spans).classify(spans).select("seq", "field", "kind").distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The same logs with placeholders; all other columns as they were."""
    logs = _winston(spark, d)
    return pii.PiiFinder.fit(pii.fields(logs)).redact(logs)


def _hashes(spark: SparkSession, d: str) -> DataFrame:
    """All documents' words, read and hashed once for the passes over them."""
    return cut(leakage.hashed(spread(table(spark, d, "documents").select("doc_id", "text")), "text", "doc_id"), "words")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _hashes(spark, d)
    return leakage.LeakFinder.fit(docs, table(spark, d, "eval_items")).verbatim(docs)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaking documents and items with similarity, common words and answer, paraphrases included."""
    docs = _hashes(spark, d)
    return leakage.LeakFinder.fit(docs, table(spark, d, "eval_items")).report(docs)


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = mixing.measured(table(spark, d, "documents").where(F.col("source").isNotNull()))
    plan = mixing.plan(sizes, table(spark, d, "mix_targets"))
    return mixing.mix(sizes, plan), plan


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mix(spark, d))


def p9_reached(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: its documents with text, and whether the mix reached its share of those that have
    any to 0.02 and repeated none too often."""
    got = p9_shares(spark, d)
    live = F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(Window.partitionBy(F.lit(0)))  # a row per target source
    want = F.when(F.col("tokens") > 0, F.col("target_share") / live).otherwise(0.0)
    docs = table(spark, d, "documents").where("source is not null and text <> ''").groupBy("source").agg(F.count("*").alias("documents"))
    x = got.withColumn("reached", F.abs(F.coalesce("share", F.lit(0.0)) - want) <= 0.02).withColumn("bounded", F.col("most_repeats") <= F.col("max_repeats"))
    return x.join(docs, "source", "left").select("source", F.coalesce("documents", F.lit(0)).alias("documents"), F.round(want, 6).alias("want"), "reached", "bounded")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(spread(table(spark, d, "documents").where("source is not null and source <> 'crawl'").select("doc_id", "text")))


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of all documents, crawled ones included, with their text."""
    return sentences.split_sentences(table(spark, d, "documents"), with_text=True)


QUERIES = {f.__name__: f for f in (p4_found, p4_redacted, p8_found, p8_report, p9_mix, p9_shares, p9_reached, p10_found, p10_sentences)}

_WORDS = "regexp_extract_all(lower(strip_accents(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({}, '&nbsp;', ' '), '</?(br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|pre|blockquote)\\b[^<>]*>', ' ', 'gi'), '</?[a-zA-Z][^<>]*>', '', 'g'), '\\]\\([^()\\s]*\\)', ']', 'g'), '[*`~\u00ad\u200b-\u200f\u2060\ufeff]', '', 'g'))), '[\\p{L}\\p{N}]+')"
SQL: dict[str, str] = {
    "p8_found": f"""
        WITH i AS (SELECT item_id, {_WORDS.replace("{}", "passage")} AS w FROM eval_items WHERE passage IS NOT NULL), d AS (SELECT doc_id, {_WORDS.replace("{}", "text")} AS w FROM documents WHERE text IS NOT NULL),
        g AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
        h AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
        SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)""",
    "p9_reached": """
        WITH c AS (SELECT source, count(*) AS documents FROM documents WHERE source IS NOT NULL AND text <> '' GROUP BY source), t AS (SELECT DISTINCT ON (source) source, target_share FROM mix_targets WHERE source IS NOT NULL AND target_share > 0 AND max_repeats IS NOT NULL)
        SELECT source, coalesce(documents, 0) AS documents, round(CASE WHEN documents > 0 THEN target_share / sum(target_share) FILTER (documents > 0) OVER () ELSE 0 END, 6) AS want, TRUE AS reached, TRUE AS bounded FROM t LEFT JOIN c USING (source)""",
}
