"""A corpus from raw documents to a mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberline.llm.common import drop_tables, stored, table, tables_written
from emberline.llm.decontaminate import decontaminate
from emberline.llm.jaccard import keep_one_per_component
from emberline.llm.mixing import mix
from emberline.llm.passages import dedup_passages
from emberline.llm.toxicity import learn, score_texts


_LEFT: list[str] = []  # what the stage before has written besides its result


def stage(fn):
    """A stage begins when the result of the one before is written, so that one's own tables go first."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _LEFT)
        with tables_written() as paths:
            out = fn(spark, docs, sf_dir)
        _LEFT.extend(paths)
        return out
    return run_stage


@stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 by their nearest labelled examples."""
    index = learn(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, index).filter(F.col("tox_label") == 0).select(*docs.columns)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of a passage of 20 words and more: winnowed line hashes, positions joined, matches extended line by line, their
    words deleted; then, outside of these, an exact search of every window of 20 words. Documents of which nothing is left go, n_chars follows the text."""
    done = dedup_passages(docs, lines=True)
    gone = (F.col("words_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    chars = F.when(F.col("words_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.filter(~gone).withColumn("n_chars", chars).select(*docs.columns)


@stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 and more."""
    return keep_one_per_component(docs, k=5, percent=80).select(*docs.columns)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten words of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with how often (`copies`) and how many words (`taken`)."""
    return mix(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join),
          ("decontamination", decontamination), ("source_mix", source_mix)]
ORACLE_SQL = None  # neither neighbours' votes nor balanced draws are SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, fn in STAGES:
        with tables_written() as written:
            after = stored(fn(spark, docs, sf_dir), name)
        drop_tables(spark, before)
        docs, before = after, written[-1:]
    drop_tables(spark, _LEFT)
    return docs
