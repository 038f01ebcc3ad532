"""A training corpus from `documents`: rules, near-duplicates, repeated passages, mix, packing.

Each stage reads what the one before it wrote. All but the last return the columns of documents, in any
type and number, with doc_id, text and source among them; of the others only n_chars is changed, to
follow a changed text. A stage's folder goes once the next one is written.

Defined cases, in every stage: an empty table gives an empty one; very long texts are read whole; rows
that repeat are judged alike; columns of other names, even those that operators use inside, pass as
they are. What a stage does with nulls, empty texts and ties is said at each.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, packing, quality, simhash, substring
from quarry.operators.components import shared_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go; null and empty texts are among them."""
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality.judge(docs, rules).where("kept")
    return judged.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id (null last, ties by text, then by all columns).

    Fingerprints find the candidates, and those are linked whose sets of five-word shingles have a
    similarity of at least 0.8. Null texts and texts without words are one group.
    """
    return simhash.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand in a document of smaller doc_id go, with the white space after them.

    A text that loses none stays as it is; a null text stays null, and a null doc_id is larger than all others.
    """
    d = substring.dedup_substrings(docs, keep_space=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row")["text"])
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length(text).cast("long")).otherwise(F.col("row")["n_chars"])}
    return d.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: documents, and parts of some, as often as they are taken.

    Nothing is taken of null and empty texts; the null source is the last one.
    """
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences that hold the mix, in the order in which tasks read it; a null text is the end id alone."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenization can't be written in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    base = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
