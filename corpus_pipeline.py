"""The corpus pipeline: documents in, packed training sequences out. Every stage is written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import langid, lines, minhash, mixing, packing
from runloom.llm.common import fresh, stored
from runloom.llm.plans import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents go whose text is null, has no letter, or fits no learned language with a score of 0.5."""
    learned = docs.where(~langid.held_out_fold(F.col("doc_id")))
    return langid.keep_identified(docs, langid.learn(learned.select("doc_id", "text", "lang")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts without lines that three or more documents share; n_chars is that of the new text."""
    kept = lines.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else kept


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup, five words and a similarity of 0.8: of each group the smallest doc_id stays, once."""
    found = minhash.near_duplicates(docs, size=5, percent=80).where("kept")
    d, t, w = fresh(docs, "near_doc_", "near_twin_", "near_own_")
    # one of rows that share doc_id and text; rows that share the doc_id alone are told apart by the text
    kept = stored(found.select(F.col("doc_id").alias(d), F.col("twin").alias(t)).distinct(), "near-kept")
    own = docs.withColumn(w, F.xxhash64("text"))
    return own.join(kept, own["doc_id"].eqNullSafe(kept[d]) & (own[w] == kept[t])).dropDuplicates(["doc_id", w]).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as the mix takes its words, rounded to whole documents."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of all documents with their place in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages learn, sketch and tokenize, which SQL cannot say; tests hold near dedup and mixing against plain versions, the other operators on their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"stage-{name}")
    return docs
