"""The registered queries of this package: each operator, with its production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsieve.llm import bpe, conversations, decontaminate, html, langid, licences, mixing, perplexity, phrases, quality, repeats, simhash, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return perplexity.classify(documents, table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    said = langid.predict(documents.select("doc_id", "text"), langid.train(documents))
    return said.select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(documents, quality.learn(quality.labelled(documents, table(spark, sf_dir, "labels"))))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.interleave(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.digest(decontaminate.find_matches(documents, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), html.train(html.labelled_pages()))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("text").withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")})


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_perplexity": op1_perplexity,
    "op2_warc": op2_warc,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_decontaminate": op6_decontaminate,
    "op7_main_text": op7_main_text,
    "op8_repeats": op8_repeats,
    "op9_simhash": op9_simhash,
    "op10_licences": op10_licences,
    "op11_conversations": op11_conversations,
    "op12_bpe": op12_bpe,
    "op13_phrases": op13_phrases,
}
