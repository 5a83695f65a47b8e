"""One query per operator over the driver's tables, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from emberline.llm import ann, chat, decontaminate, jaccard, langid, licenses, mixing, negatives, passages, secrets, tokens, topk, toxicity
from emberline.llm.common import held_out, table
from emberline.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_one_bit_neighbours(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_texts(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"),
                         F.col("tox_label").alias("predicted"), "evidence")


@query
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "shares")


@query
def op4_secret_scan(spark, sf_dir):
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
                        F.array_join("spans", ",").alias("spans"), "n_entropy")


@query
def op5_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).drop("key")


@query
def op6_license_scan(spark, sf_dir):
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    said = F.transform("matches", lambda m: F.concat_ws(":", m["license"], F.round(m["containment"] * 1000).cast("int").cast("string"), m["start"].cast("string")))
    return found.select("doc_id", "n_licenses", F.coalesce(F.array_join(said, ","), F.lit("")).alias("licenses"))


@query
def op7_line_dedup(spark, sf_dir):
    return passages.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_mixing(spark, sf_dir):
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op9_decontamination(spark, sf_dir):
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op10_chat_formatting(spark, sf_dir):
    return chat.rendered_turns(table(spark, sf_dir, "conversations"))


@query
def op11_token_alignment(spark, sf_dir):
    found = tokens.alignment_strength(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


@query
def op12_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query
def op13_hard_negatives(spark, sf_dir):
    # the contract's planted label errors: every seventh row counts as of the next label
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
