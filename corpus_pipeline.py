"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. All but the last
return the columns of documents. ``run`` checkpoints between stages, as a run that writes each
stage's rows and reads them again would. Word pieces have no SQL form, so there is no oracle; the
tests hold each stage's rows against plain loops, SQL or the tokenizers library.

Null ids, texts and sources, empty, very long and repeated texts and empty tables go through every
stage by its operator's rules: documents without words fail the first stage, of repeated or similar
rows one stays, a null source is a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import bpe, jaccard, linedup, mixing, quality
from flowlake.llm.common import cut
from flowlake.llm.queries import word_bpe


def measured(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, the character count as the text now is."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines go from the others."""
    return measured(quality.quality_rules(docs, cleaned=True).where("kept"), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks go from later documents; documents with nothing left go."""
    rows = linedup.dedup_lines(docs)
    return measured(rows.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids, with digests of the ids and of the text they decode to."""
    rows = bpe.round_trip(docs, word_bpe())
    decoded = F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    return rows.select("doc_id", "lang", "source", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), decoded)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_duplicate_stage),
    ("source mix", mixing_stage),
    ("word pieces", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
