"""From documents to packed training sequences: toxicity, language, near-duplicates, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm import decontamination, language_id, minhash_dedup, packing, toxicity
from cohortry.llm.common import Scratch, broadcast_if_small, table
from cohortry.llm.queries import TOXIC, language_profiles, toxicity_network

# SQL cannot express trained networks and profiles.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no window scores TOXIC or more."""
    scored = toxicity.score_toxicity(docs, toxicity_network(spark, sf_dir))
    return scored.where(F.col("toxicity") < TOXIC).drop("toxicity")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; texts without letters go, and those that point away from every profile."""
    judged = language_id.identify_languages(docs, language_profiles(spark, sf_dir))
    known = (F.col("lang_pred") != "und") & (F.col("score") > 0)
    return judged.where(known).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8: that with the smallest id, once if its row is repeated."""
    scratch = Scratch(spark)
    found = scratch.store(minhash_dedup.near_duplicates(docs, percent=80))
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)
    repeated = scratch.store(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    again = broadcast_if_small(repeated)
    once = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaked = decontamination.leaked_items(table(spark, sf_dir, "benchmark"), F.col("text"))
    return docs.where(F.size(leaked) == 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, placed in sequences."""
    pieces = packing.cut_documents(docs, emit=["ids_crc32"])
    packed = packing.pack_pieces(pieces, Scratch(spark))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is stored before the next begins."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.store(docs)
            scratch.drop(before)
    return docs
