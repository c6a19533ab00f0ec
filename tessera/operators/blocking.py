"""Candidate generation.

Inputs are normalized records with entity_id, country, src (S1, S2 or S3), norm_name, norm_addr and
numeric_tokens. S2 and S3 are blocked apart, so (country, source) is part of every key; nothing loops over
countries. Every choice among equals is settled by id, and scores are rounded to nine digits first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cosine import best_pairs
from tessera.session import together
from tessera.sources.tables import staged

#: The limits of the passes.
TOP_NAME, TOP_ADDR, TOP_NUMERIC, TOP_ALL = 20, 20, 30, 100
VOCABULARY, MIN_DF, MIN_SCORE, MIN_NUMBER, MAX_NUMBER_DF = 30_000, 3, 0.05, 3, 500


def terms(c: Column) -> Column:
    """V1: words of two characters or more, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    pairs = F.when(F.size(words) > 1, F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def corpus(records: DataFrame) -> DataFrame:
    """V7: the rows of S1 once for each other source (`source`), and those of the source."""
    first = records.where("src = 'S1'").select("*", F.explode(F.array(F.lit("S2"), F.lit("S3"))).alias("source"))
    return first.unionByName(records.where("src <> 'S1'").withColumn("source", F.col("src"))).where("country is not null")


def ranked_vocabulary(records: DataFrame, field: str, counts: DataFrame | None = None) -> DataFrame:
    """Country, source, term, rank, df, ctf, idf. counts: term_counts, if they have been computed."""
    rows = corpus(records)
    n = rows.groupBy("country", "source").agg(F.count("*").alias("n"))
    counted = (term_counts(records, field) if counts is None else counts).groupBy("country", "source", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ctf")).where(F.col("df") >= MIN_DF)
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("country", "source").orderBy(F.desc("ctf"), "term"))).where(F.col("rank") <= VOCABULARY)
    return ranked.join(n, ["country", "source"]).select("country", "source", "term", "rank", "df", "ctf", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def vocabulary(records: DataFrame, field: str) -> DataFrame:
    """ranked_vocabulary without the ranks."""
    return ranked_vocabulary(records, field).drop("rank")


def term_counts(records: DataFrame, field: str) -> DataFrame:
    """Country, source, src, entity_id, term, tf."""
    exploded = corpus(records).select("country", "source", "src", "entity_id", F.explode(terms(F.col(field))).alias("term"))
    return exploded.groupBy("country", "source", "src", "entity_id", "term").agg(F.count("*").alias("tf"))


def weights(records: DataFrame, field: str) -> DataFrame:
    """V3, V4: country, source, src, entity_id, term, rank, w."""
    counts = staged(term_counts(records, field), "terms")
    return counts.join(ranked_vocabulary(records, field, counts), ["country", "source", "term"]).select("country", "source", "src", "entity_id", "term", "rank", ((1.0 + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w"))


def unit_vectors(records: DataFrame, field: str) -> DataFrame:
    """V3-V5: country, source, src, entity_id, term, u; every entity's u has length one."""
    key = ["country", "source", "src", "entity_id"]
    return weights(records, field).select(*key, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*key)))).alias("u"))


def packed_vectors(records: DataFrame, field: str) -> DataFrame:
    """unit_vectors, a row for each entity: country, source, src, entity_id, terms (ranks), u."""
    rows = weights(records, field).groupBy("country", "source", "src", "entity_id").agg(F.collect_list(F.struct("rank", "w")).alias("x"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return rows.select("country", "source", "src", "entity_id", F.col("x.rank").alias("terms"), F.transform("x.w", lambda w: w / F.col("length")).alias("u"))


def tfidf_topk(records: DataFrame, field: str, k: int) -> DataFrame:
    """source1_entity_id, candidate_id, source, score: the k best by cosine of at least MIN_SCORE.

    Blocks of the two sides of a country and source meet in tasks that multiply them and hand on the k best of each
    block, so that the products are never rows. Term counts and vectors are written once and read by each of their uses."""
    return top(best_pairs(staged(packed_vectors(records, field), "vectors"), k, MIN_SCORE), F.desc("score"), k)


def top(pairs: DataFrame, by: Column, k: int) -> DataFrame:
    """The k first rows of each (source1_entity_id, source)."""
    w = Window.partitionBy("source1_entity_id", "source").orderBy(by, "candidate_id")
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")


def number_counts(records: DataFrame) -> DataFrame:
    """Country, source, token, df of the candidates' numbers."""
    each = records.where("src <> 'S1'").select("country", F.col("src").alias("source"), F.explode("numeric_tokens").alias("token"))
    return each.where(F.char_length("token") >= MIN_NUMBER).groupBy("country", "source", "token").agg(F.count("*").alias("df"))


def numeric_topk(records: DataFrame, k: int = TOP_NUMERIC, max_df: int = MAX_NUMBER_DF) -> DataFrame:
    """C4, D3, S3: source1_entity_id, candidate_id, source, shared. A number held by more than max_df
    candidates is dropped, which bounds the fan-out of a join key."""
    rare = number_counts(records).where(F.col("df") <= max_df).drop("df")
    right = records.where("src <> 'S1'").select("country", F.col("src").alias("source"), F.col("entity_id").alias("candidate_id"), F.explode("numeric_tokens").alias("token")).join(rare, ["country", "source", "token"], "left_semi")
    left = records.where("src = 'S1'").select("country", F.col("entity_id").alias("source1_entity_id"), F.explode("numeric_tokens").alias("token")).where(F.char_length("token") >= MIN_NUMBER)
    return top(left.join(right, ["country", "token"]).groupBy("source", "source1_entity_id", "candidate_id").agg(F.count("*").alias("shared")), F.desc("shared"), k)


def merged_passes(name: DataFrame, addr: DataFrame, numeric: DataFrame) -> DataFrame:
    """One row per pair; a pass that did not find the pair counts zero. combined orders the cap."""
    zero, key = F.lit(0.0), ["source", "source1_entity_id", "candidate_id"]
    one = name.select(*key, F.col("score").alias("n"), zero.alias("a"), F.lit(0).cast("long").alias("c"))
    two = addr.select(*key, zero.alias("n"), F.col("score").alias("a"), F.lit(0).cast("long").alias("c"))
    three = numeric.select(*key, zero.alias("n"), zero.alias("a"), F.col("shared").alias("c"))
    pairs = one.unionByName(two).unionByName(three).groupBy(*key).agg(F.max("n").alias("name_score"), F.max("a").alias("addr_score"), F.max("c").alias("shared"))
    return pairs.withColumn("combined", F.round(F.col("name_score") + F.col("addr_score") + 0.1 * F.least("shared", F.lit(5)), 9))


def capped(pairs: DataFrame, k: int = TOP_ALL) -> DataFrame:
    """The k best pairs of an S1 record over both sources."""
    w = Window.partitionBy("source1_entity_id").orderBy(F.desc("combined"), "source", "candidate_id")
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("source1_entity_id", "candidate_id", "name_score", "addr_score", (F.col("shared") > 0).cast("int").alias("numeric_match"), "source")


def deduplicated(candidates: DataFrame) -> DataFrame:
    """Of equal pairs from both sources the better one."""
    best = F.round(F.col("name_score") + F.col("addr_score") + F.col("numeric_match"), 9)
    w = Window.partitionBy("source1_entity_id", "candidate_id").orderBy(F.desc("best"), "source")
    return candidates.withColumn("best", best).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "best")


def generate_candidates(records: DataFrame, top_name: int = TOP_NAME, top_addr: int = TOP_ADDR) -> DataFrame:
    """G7."""
    name, addr = together(records.sparkSession, lambda: tfidf_topk(records, "norm_name", top_name), lambda: tfidf_topk(records, "norm_addr", top_addr))
    return deduplicated(capped(merged_passes(name, addr, numeric_topk(records))))


def pass_recall(name: DataFrame, addr: DataFrame, numeric: DataFrame, truth: DataFrame) -> DataFrame:
    """Found shares of the truth pairs after one, two and three passes. truth: source1_entity_id, candidate_id."""
    flags = merged_passes(name, addr, numeric).groupBy("source1_entity_id", "candidate_id").agg(F.max(F.col("name_score") > 0).alias("by_name"), F.max(F.col("addr_score") > 0).alias("by_addr"), F.max(F.col("shared") > 0).alias("by_number"))
    j = truth.distinct().join(flags, ["source1_entity_id", "candidate_id"], "left")
    has = lambda *c: F.count_if(F.coalesce(F.greatest(*c) if len(c) > 1 else c[0], F.lit(False)))
    return j.agg(F.count("*").alias("n_truth"), has(F.col("by_name")).alias("after_name"), has(F.col("by_name"), F.col("by_addr")).alias("after_addr"), has(F.col("by_name"), F.col("by_addr"), F.col("by_number")).alias("after_numeric"))
