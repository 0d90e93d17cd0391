"""The corpus pipeline: five operators in a row, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.  ``run`` writes each stage's result as Parquet in the shared checkpoint folder, reads it
again as the next one's input and then removes what the stage before it wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pleat.llm import fm_classifier, jaccard, packing, quality_rules, secrets
from pleat.llm.queries import table, vocabulary
from pleat.llm.runtime import ensure_checkpoint_dir, remove_folder


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps; those that fail the base tests go.

    A null or empty text fails; repeated rows and rows without an id are judged like any other; an
    empty table stays empty.
    """
    return quality_rules.judge(docs).where("kept").select(*docs.columns)


def keep_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of what is left, does not reject.

    A null text is scored as an empty one; rows without an id are scored like any other; without labels
    of both kinds nothing is learned and all rows get the same verdict; an empty table stays empty.
    """
    model = fm_classifier.fit_quality(docs, table(spark, sf_dir, "labels"))
    return fm_classifier.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the smallest id.

    Documents without an id belong to no group and stay, as do those without words.  Of rows that share
    an id the one with the smallest text stays.  An empty table stays empty.
    """
    groups = jaccard.jaccard_components(docs, words=5, percent=80)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rest = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    kept = kept.groupBy("doc_id").agg(F.min_by(row, F.struct("text", rest)).alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced by its kind; n_chars follows the text, null for a null text."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; a null text is one id, an empty table gives no rows."""
    packed = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), keep=["doc_id"])
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_classifier),
    ("ngram_jaccard", keep_one_of_each),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: The stages are learned models, similarity components and a tokenizer: no SQL. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
