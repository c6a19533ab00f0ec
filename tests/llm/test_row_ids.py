from pyspark.sql import functions as F

from tessera.llm import suffix_dedup

PASSAGE = "the quick brown fox jumps over the lazy dog while ten small mice watch it from under an old oak table"


def test_batches_of_far_partitions(spark):
    """Batch numbers as of the 512th and later input splits."""
    docs = spark.createDataFrame([(i, f"{i} {PASSAGE} {i}") for i in range(6)], "doc_id long, text string").coalesce(1)
    for split in (512, 5000, (1 << 31) - 1):
        packed = suffix_dedup.pack_batches(docs, "doc_id", "text").withColumn("batch", F.col("batch") + (split << 32))
        copies = suffix_dedup.lay_copies(packed, 50)
        runs = suffix_dedup.candidate_runs(packed, copies, suffix_dedup.lay_shared(packed, copies, 2, 50, 24), 2, 50, 24)
        removed = suffix_dedup.lay_removed(runs, suffix_dedup.merged_ids(suffix_dedup.index_strings(runs), 50), 50)
        got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.cut(packed, copies, removed, "struct<none:int>").collect()}
        assert got == {i: f"{i}{i}" if i else f"0 {PASSAGE} 0" for i in range(6)}


def test_hot_minimizers_are_told_by_window(spark, monkeypatch):
    """The result is the same whether a frequent minimizer's runs are told whole or window by window."""
    texts = [f"{'ab' * (i % 7)}{i} {PASSAGE} {i * i}" + f" tail {i % 3} " * (i % 5) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    told = lambda: {r.doc_id: (r.n_removed, r.kept) for r in suffix_dedup.repeats(docs).collect()}
    whole = told()
    monkeypatch.setattr(suffix_dedup, "WIDE", 1)
    assert told() == whole and sum(n for n, _ in whole.values()) > 79 * len(PASSAGE)
