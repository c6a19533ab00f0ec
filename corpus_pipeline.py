"""Corpus pipeline: documents -> quality rules -> near-dedup -> repeat removal -> decontamination -> packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's result as Parquet to the shared folder and reads it back. A stage deletes the
tables that the stages before it left behind, so a stage's result is to be written before the next stage is called.

Null texts count as empty. Rows may lack an id or share one: they are told apart. Empty tables give empty tables.
Columns of any name and type are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.beside import ROW_BITS, lay, without
from tessera.llm.common import discard, leave, materialize, sweep
from tessera.llm.decontaminate import decontaminated
from tessera.llm.near_copies import near_copies
from tessera.llm.packing import pack
from tessera.llm.quality_rules import filter_documents, good_labels
from tessera.llm.suffix_dedup import drop_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    sweep(docs)
    return filter_documents(docs, good_labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (sets of five-word shingles with Jaccard similarity 0.8 or more) one row
    stays: that with the smallest doc_id, null ids last, and of equal ids the first row. Rows are told apart by a
    key of their own: rows that share an id or have none stay if they are no copies."""
    sweep(docs)
    key = "__row"
    while key in docs.columns:
        key += "_"
    rows = leave(materialize(docs.withColumn(key, F.monotonically_increasing_id()), "rows"))
    found = near_copies(rows.select(F.col(key).alias("doc_id"), "text"), 5, 0.8)
    groups = materialize(found.withColumnRenamed("doc_id", "row").join(rows.select(F.col(key).alias("row"), "doc_id"), "row"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = materialize(groups.groupBy("group").agg(F.min(order)["row"].alias("first")), "first")
    gone = lay(groups.join(first, "group").where("row <> first").select(F.col("row").alias(key)), "gone", key, ROW_BITS)
    for table in (found, groups, first):
        discard(table)
    return without(rows, gone, key).select(*docs.columns)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat an earlier document's go, cut back to whole characters; emptied documents go."""
    sweep(docs)
    return drop_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    sweep(docs)
    found = decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("__matches") == 0).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 token ids, one row per piece."""
    sweep(docs)
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "ids")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("repeat_removal", repeat_removal), ("decontamination", decontamination), ("packing", packing)]

#: The stages hash, merge and tokenize: no SQL expresses them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = leave(materialize(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
