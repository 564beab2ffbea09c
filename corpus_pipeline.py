"""Corpus pipeline: quality rules, near-duplicates, personal data, source mix, packing; each stage on what the last one kept.

All stages take nulls in any column, columns of any further name, and an empty table, which stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import common, mixing, packing, pii, quality, simhash


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose lines that too many documents of their source hold.

    Null and empty texts are rejected (no words); a null source is a source of its own. Rows with equal id, source and text get
    one verdict and stay as often as they came; copies under different ids are one vote.
    """
    return _measured(quality.cleaned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: that with the smallest id, then the smallest hashes of its text
    and of its whole row.

    Null and empty texts have fingerprint zero and are linked like any other; a null id counts as the smallest. Of repeated rows one stays;
    of rows with the same id and text but other columns it is the same one in every run.
    """
    identity = F.struct(F.col("doc_id"), F.xxhash64(F.col("text").isNull(), "text").alias("h"))
    own, same, n = common.free_names(docs, "own", "same", "n")
    rows = docs.withColumn(own, identity)
    groups = simhash.near_duplicates(rows, own).where(F.col(own) == F.col("component_id"))
    chosen = common.saved(groups.groupBy(F.col(own).alias(same)).agg(F.count("*").alias(n)), "chosen")
    once = rows.join(chosen.where(F.col(n) == 1), F.col(own).eqNullSafe(F.col(same))).select(*docs.columns)
    several = rows.join(chosen.where(F.col(n) > 1), F.col(own).eqNullSafe(F.col(same)))
    whole = F.struct(F.xxhash64(*[x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]), F.hash(*docs.columns))
    several = several.groupBy(own).agg(F.min_by(F.struct(*docs.columns), whole).alias(n)).select(f"{n}.*")
    return once.unionByName(several)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. No row goes; null and empty texts stay as they are, repeated rows stay alike."""
    return _measured(pii.redacted(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that each source has its target; the last one of a source may be cut.

    Null and empty texts have no words and go; a null source is the last source. Rows that are alike share what they take.
    """
    return _measured(mixing.repeated(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequence and place. Null and empty texts are pieces of their end token;
    repeated rows are packed as often as they stand."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules), ("SimHash near-duplicates", near_duplicates), ("personal data", personal_data),
    ("source mix", source_mix), ("best-fit packing", best_fit_packing),
]

#: Fingerprints, random order and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each one's rows are written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
