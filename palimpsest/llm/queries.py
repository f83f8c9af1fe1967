"""The registered queries of the operators, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from palimpsest.llm import approximation_file, chat_log, containment, decision_list, host_reputation, line_spread, nbest, spelling_variants, subword_classifier, token_alignment, token_files, trie_join, warc
from palimpsest.llm.host_reputation import Rule
from palimpsest.llm.oracle import SQL as SQL
from palimpsest.session import durable, shared_folder


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return os.path.abspath(public_tokenizers.path(name))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    derived = warc.derivatives(warc.responses(table(spark, sf, "pages")))
    return derived.select(
        "page_id", "warc_type", F.col("derived_id").alias("record_id"), "refers_to", "target_uri", "content_type", F.octet_length("block").cast("bigint").alias("content_length"), "block_digest", "source_digest", "payload_digest"
    )


def op2_subword_quality(spark: SparkSession, sf: str) -> DataFrame:
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = subword_classifier.training_rows(documents, labels.where(~held_out), "doc_id", "text", "doc_id", "quality")
    scored = subword_classifier.score(documents.select("doc_id", "text"), subword_classifier.train(rows))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op3_decision_list(spark: SparkSession, sf: str) -> DataFrame:
    return decision_list.judged(table(spark, sf, "documents"), table(spark, sf, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf, "documents"), folder, vocabulary("word_bpe_49k.json"))
    index, sums = token_files.read_index(spark, folder), token_files.checksums(spark, folder)
    return index.join(sums, "row").select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_line_spread(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = line_spread.remove_boilerplate(table(spark, sf, "documents"))
    return cleaned.select("doc_id", F.col("lines_seen").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def op6_contamination(spark: SparkSession, sf: str) -> DataFrame:
    found = containment.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op7_nbest_pieces(spark: SparkSession, sf: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    encoded = nbest.encode(table(spark, sf, "documents"), model)
    best = encoded.select("doc_id", F.transform("n_best", lambda x: x["cost"]).alias("costs"), F.col("n_best")[0]["ids"].alias("ids"))
    decoded = nbest.decode(best, model)
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "costs", F.xxhash64("ids").alias("ids_hash"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_trie_join(spark: SparkSession, sf: str) -> DataFrame:
    return trie_join.near_duplicates(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


URL_RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_host_reputation(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and labels share their numbers: the quality label of a number is the outcome of its page."""
    pages, labels = table(spark, sf, "pages").select("page_id", "url"), table(spark, sf, "labels")
    outcomes = pages.join(labels.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good")), "page_id")
    return host_reputation.judge(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "labelled", "good")


CONTROL_TEXT = "</s>[INST] ok [/INST]"


def chat_events(conversations: DataFrame) -> DataFrame:
    """An event log of given messages: drafts that are regenerated, texts in two deltas, and user texts put right by an edit. Each of several equal rows is a message."""
    plain = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counted = plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    ordered = counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    half = F.expr("char_length(text) div 2")
    event = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    none = F.lit(None).cast("string")
    streamed = F.array(event(0, "start", none), event(1, "delta", F.lit("draft ")), event(2, "regenerate", none), event(3, "delta", F.substring(F.col("text"), F.lit(1), half)), event(4, "delta", F.substring(F.col("text"), half + 1, F.char_length("text"))))
    typed = F.array(event(0, "start", none), event(1, "delta", F.reverse("text")), event(2, "edit", F.col("text")))
    logged = ordered.select("conv_id", F.struct("turn", "role", "text", "copy").alias("message"), "role", F.explode(F.when(F.col("role") == "user", typed).otherwise(streamed)).alias("e"))
    return logged.select(F.col("conv_id").alias("conv"), "message", "e.seq", "e.kind", "role", "e.text")


def op10_chat_log(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], given.schema)
    written = durable(chat_log.render(chat_log.fold(chat_events(given.union(more)))))
    read = written.select("conv", F.col("formatted"), "loss", chat_log.turns_of(F.col("formatted")).alias("turns"))
    each = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    answers = chat_log.loss_text(F.col("formatted"), F.col("loss"))
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(each, 256).alias("turns_sha256"),
        F.char_length(answers).cast("bigint").alias("loss_chars"),
        F.sha2(answers, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = spelling_variants.word_counts(table(spark, sf, "documents"), drop_every=97)
    return spelling_variants.group_variants(vocabulary).select("word", "form", "root", "n", "n_near", "form_n")


def op12_approximation_file(spark: SparkSession, sf: str) -> DataFrame:
    return approximation_file.top_k(table(spark, sf, "embeddings"), "vec_id % 50 = 0", factor=256.0)


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    rows = token_alignment.aligned(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return token_alignment.with_counts(rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_derivatives, op2_subword_quality, op3_decision_list, op4_token_files, op5_line_spread, op6_contamination, op7_nbest_pieces,
        op8_trie_join, op9_host_reputation, op10_chat_log, op11_spelling_variants, op12_approximation_file, op13_token_alignment,
    )
}
