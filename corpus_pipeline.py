"""A corpus pipeline of five stages: language ID, MinHash near-dedup, suffix-array dedup, benchmark decontamination, BPE encoding.

Each stage takes what the one before it kept. All but the last return the columns of documents; a stage's extra columns and null or repeated rows are treated as its operator says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import op2_suffix, op3_decontaminate, op5_minhash, op6_langid, op10_bpe
from tracewell.llm.common import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: those without letters, and those whose calibrated probability is low."""
    model = op6_langid.fit(docs.where(~op6_langid.held_out(F.col("doc_id"))))
    return op6_langid.identify(docs, model, keep=COLUMNS).where("NOT rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (shingles of five words, similarity of 0.8 or more), the one with the smallest id. Of rows that repeat an id and a text one stays; rows of that id with other texts are not dropped for it."""
    kept = op5_minhash.near_duplicates(docs, shingle=5, percent=80).where("kept").select("doc_id").distinct()
    own = docs.select(*COLUMNS)
    if own.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").limit(1).count():
        own = own.where("doc_id IS NULL").unionByName(own.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]))
    return own.join(kept.hint("merge"), own["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes are cut out of the texts; a document of which nothing is left goes."""
    cut = op2_suffix.without_repeats(docs, with_text=True, keep=["lang", "source", "n_chars"])
    left = cut.where("n_bytes = 0 OR n_removed < n_bytes")
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = op3_decontaminate.contamination(docs, benchmark).where("contaminated").select("doc_id", F.col("key").alias("_key"))
    own = docs.select(*COLUMNS).withColumn("_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    return own.join(bad, own["doc_id"].eqNullSafe(bad["doc_id"]) & (own["_key"] == bad["_key"]), "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens."""
    return op10_bpe.encode_documents(docs, op10_bpe.vocabulary_path(), with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_text", repeated_text), ("decontaminate", decontaminate), ("encode", encode)]
#: SQL can't express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/pipeline/{k}-{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
