"""A corpus from documents: toxic ones go, near copies go, personal data is masked, sources are mixed, text becomes ids.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns the next one's docs.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.llm import bpe, common, mixing, pii, simhash, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7; the model learns from labels of the rows at hand.

    Null and empty texts stay, repeated rows stay or go together; without labels every document gets the same score
    and stays. An empty table gives no rows.
    """
    scored = toxicity.score_toxicity(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scored.where(F.col("toxic_score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group with shingles of five words alike by 0.8 or more.

    Of rows that share that doc_id one stays; rows without doc_id stay. Texts without a word are one group.
    """
    marked = simhash.near_duplicates(docs)
    kept = docs.join(marked.where("keep").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data is replaced by its kind in brackets; null texts become empty ones, and no row goes."""
    masked = pii.find_pii(docs).withColumn("text", F.col("redacted"))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weights 1, 2, 3; a document may give up to three rows, one without words gives none."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's text, and the text they decode to; one row for each row, no ids for texts without a word."""
    return bpe.bpe_encode(docs.select(*COLUMNS)).withColumn("n_tokens", F.size("bpe_ids").cast("long"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near copies", drop_near_copies),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: A trained model, fingerprints and drawn counts are not for SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again.

    Once a stage is written, what the one before it wrote is removed.
    """
    shared = common.checkpoint_dir(spark).rstrip("/")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for n, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return out
        where = f"{shared}/pipeline-{uuid.uuid4().hex}-{re.sub('[^a-z]+', '-', name)}"
        out.write.parquet(where)
        docs = spark.read.parquet(where)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = where
    return docs
