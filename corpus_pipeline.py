"""A corpus pipeline: language ID, near-dedup, decontamination, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir), where
docs is what the stage before has kept.  ``run`` writes every stage's rows to the
scratch folder and rereads them.  Empty tables, null texts and repeated rows pass
as each stage states; extra columns stay with their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlab.llm.decontaminate import scan_benchmark
from flowlab.llm.language import fit, identify
from flowlab.llm.near_dedup import near_duplicates
from flowlab.llm.packing import pack_sequences
from flowlab.scratch import materialize

#: Language ID has no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or far from all languages go."""
    found = identify(docs, fit(docs))
    return found.where("accepted").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more, its smallest doc_id.

    Rows are told apart by id and text: of repeated rows one stays, and of texts
    that share the smallest id of a group the first by md5.  Documents without
    words are linked with nothing and stay.
    """
    groups = near_duplicates(docs, 80, 100).where("kept and component is not null")
    winners = materialize(
        groups.groupBy("component").agg(F.min("text_key").alias("winner_key"), F.min("doc_id").alias("winner_id"))
        .select("winner_id", "winner_key").distinct(), "winners")
    words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    marked = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("id"),
                         F.md5("text").alias("key"), words.alias("words"))
    kept = marked.where("words").join(
        winners, F.col("id").eqNullSafe(F.col("winner_id")) & (F.col("key") == F.col("winner_key")), "left_semi")
    once = kept.dropDuplicates(["id", "key"])
    return once.unionByName(marked.where("not words")).select("doc.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty lies inside a benchmark window."""
    found = scan_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_hit = 0 or 20 * n_hit < n_words").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return pack_sequences(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return materialize(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
