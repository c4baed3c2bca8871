"""From raw documents to encoded training text: five stages, each stored before the next.

A stage gets what its predecessor kept and returns the columns of documents (the
last one adds the encoding). Where a stage shortens a text it also sets n_chars.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase.llm import decontaminate, line_dedup, pieces, quality, simhash
from askbase.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their stratum's certified cutoffs go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three or more documents stay in one of them only."""
    kept = line_dedup.dedup_lines(docs.select(F.struct("*").alias("row"), "doc_id", "text"))
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return kept.select(*[now.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark passages go."""
    found = decontaminate.find_contamination(docs.select(F.struct("*").alias("row"), "text"),
                                             table(spark, sf_dir, "benchmark"))
    clean = decontaminate.judged(found).where("NOT contaminated")
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as piece ids, decoded again as a check."""
    return pieces.encode(docs, pieces.default_model())


STAGES = [("quality_rules", quality_rules), ("line_dedup", drop_repeated_lines),
          ("simhash_near_dedup", simhash_near_dedup), ("decontamination", decontamination),
          ("sentencepiece", sentencepiece)]

#: Fingerprints, certified cutoffs and piece merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
