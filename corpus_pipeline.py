"""From raw documents to token sequences: toxicity, line dedup, near duplicates, benchmark passages, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm import decontam, linededup, neardocs, sentencepieces, toxicity
from tempora.llm.common import drop_staged, fresh, staged, table

TOXIC_AT = 0.5
#: Lattice nodes that the last stage's tasks keep, and bytes of texts that they sample at once: less than the operator's own, beside what the stages
#: before have left in an executor. No result depends on them.
NODES, AT_ONCE = 250_000, 250_000


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on the labelled ones, rejects."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh("toxic_score", docs)
    return toxicity.score(docs, model, score).filter(F.col(score) < TOXIC_AT).drop(score)


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; every document stays."""
    return linededup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; SimHash and vantage-point trees find the links, a Jaccard similarity of 0.8 or more between sets of five-word shingles."""
    return neardocs.representatives(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts, checks that decoding gives them back, and samples other segmentations."""
    return sentencepieces.encoded(docs, nodes=NODES, size=AT_ONCE).drop("text")


STAGES = [("toxicity", toxic), ("line_dedup", fuzzy_lines), ("near_dedup", near_duplicates), ("decontamination", benchmark_passages), ("sentencepiece", pieces)]

#: Compression distances, SimHash components and lattice samples can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents; each result is written to the shared folder, and the one before it dropped."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
            drop_staged(before)
    return docs
