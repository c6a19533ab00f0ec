"""Linkage records derived from a table of documents, in Spark and in DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.normalize import FORMS, LEGAL_FORMS, STREET_WORDS, normalize_records
from tessera.session import shared_folder
from tessera.sources.tables import cached, version

_TAIL = "CASE doc_id % 8 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' Private Limited' WHEN 2 THEN ', Inc.' WHEN 3 THEN ' & Company' WHEN 4 THEN ' SARL' ELSE '' END"
ER_SPARK = rf"""
SELECT concat('D', cast(doc_id AS string)) AS entity_id, lang AS country, concat('S', cast(doc_id % 3 + 1 AS string)) AS src,
  CASE WHEN doc_id % 97 = 0 THEN NULL ELSE concat(array_join(slice(split(text, '\\s+'), 1, 6), ' '), {_TAIL}) END AS business_name,
  CASE WHEN doc_id % 89 = 0 THEN 'none' ELSE concat(cast(n_chars % 9000 + 100 AS string), ' ', array_join(slice(split(text, '\\s+'), 7, 3), ' '),
    ' st, ', cast(10000 + (n_chars * 7919) % 90000 AS string)) END AS business_address, text
FROM {{documents}}"""
ER = rf"""
er AS (SELECT 'D' || cast(doc_id AS varchar) AS entity_id, lang AS country, 'S' || cast(doc_id % 3 + 1 AS varchar) AS src,
  CASE WHEN doc_id % 97 = 0 THEN NULL ELSE array_to_string(string_split_regex(text, '\s+')[1:6], ' ') || {_TAIL} END AS business_name,
  CASE WHEN doc_id % 89 = 0 THEN 'none' ELSE cast(n_chars % 9000 + 100 AS varchar) || ' ' || array_to_string(string_split_regex(text, '\s+')[7:9], ' ') ||
    ' st, ' || cast(10000 + (n_chars * 7919) % 90000 AS varchar) END AS business_address, text FROM documents)"""
TRUTH = """
er_truth AS (SELECT a.entity_id AS source1_entity_id, coalesce(string_agg(b.entity_id, ',' ORDER BY b.entity_id), '') AS matched_entity_ids
  FROM er a LEFT JOIN er b ON b.src <> 'S1' AND a.country = b.country AND substr(a.text, 1, 40) = substr(b.text, 1, 40) WHERE a.src = 'S1' GROUP BY a.entity_id)"""


def er(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ER_SPARK.format(documents=f"parquet.`{sf_dir}/documents.parquet`"))


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: normalized once a version of the table, then read."""
    config = {"input": version(spark, f"{sf_dir}/documents.parquet"), "step": "normalize_records"}
    return cached(spark, shared_folder(spark), "normalized", config, lambda: freshly_normalized(spark, sf_dir))


def freshly_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_records(er(spark, sf_dir).drop("text"))


def er_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = er(spark, sf_dir).select("entity_id", "country", "src", F.substring("text", 1, 40).alias("head"))
    right = rows.where("src <> 'S1'").groupBy("country", "head").agg(F.array_join(F.array_sort(F.collect_list("entity_id")), ",").alias("ids"))
    return rows.where("src = 'S1'").join(right, ["country", "head"], "left").select(F.col("entity_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))


def _street(c: str) -> str:
    for short, long in STREET_WORDS.items():
        c = rf"regexp_replace({c}, '\b{short}\b', '{long}', 'g')"
    return c


_CLEAN = r"trim(regexp_replace(regexp_replace(replace(lower(strip_accents(coalesce(business_name, ''))), '&', ' and '), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_FORM = rf"'^(.*?)(?:^|\s)({FORMS})(?:\s|$)(.*)$'"
_MAP = "CASE form " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEGAL_FORMS.items()) + " ELSE '' END"
_ADDR = "lower(strip_accents(CASE WHEN business_address IN ('nan', 'null', 'none') THEN '' ELSE coalesce(business_address, '') END))"
NORM = rf"""{ER},
cleaned AS (SELECT *, {_CLEAN} AS clean, trim(regexp_replace(regexp_replace({_street(_ADDR)}, '[,./\-#()"'']', ' ', 'g'), '\s+', ' ', 'g')) AS norm_addr FROM er),
formed AS (SELECT *, regexp_extract(clean, {_FORM}, 2) AS form FROM cleaned),
parts AS (SELECT *, {_MAP} AS norm_suffix, CASE WHEN form = '' THEN clean ELSE trim(trim(regexp_extract(clean, {_FORM}, 1)) || ' ' || trim(regexp_extract(clean, {_FORM}, 3))) END AS norm_core FROM formed),
norm AS (SELECT entity_id, country, src, text, norm_core, norm_suffix, trim(norm_core || ' ' || norm_suffix) AS norm_name, norm_addr,
  list_sort(list_distinct(list_filter(regexp_extract_all(norm_addr, '\b\d+\b'), lambda x: length(x) >= 2))) AS numeric_tokens,
  coalesce(regexp_matches(business_name, '[^\x00-\x7F]'), false) AS is_non_latin FROM parts)"""


def tfidf_sql(field: str, tag: str, k: int = 20) -> str:
    """CTEs tok_, voc_, unit_ and topk_<tag>."""
    return rf"""
words_{tag} AS (SELECT country, s.source, src, entity_id, regexp_extract_all(lower(norm_{field}), '[\p{{L}}\p{{N}}_]{{2,}}') AS w
  FROM norm, (VALUES ('S2'), ('S3')) s(source) WHERE country IS NOT NULL AND (src = 'S1' OR src = s.source)),
tok_{tag} AS (SELECT country, source, src, entity_id, term, count(*) AS tf FROM (SELECT country, source, src, entity_id,
  unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words_{tag}) GROUP BY ALL),
size_{tag} AS (SELECT country, source, count(*) AS n FROM words_{tag} GROUP BY ALL),
voc_{tag} AS (SELECT country, source, term, df, ctf, ln((1 + n::DOUBLE) / (1 + df)) + 1 AS idf FROM (SELECT *, row_number() OVER (PARTITION BY country, source ORDER BY ctf DESC, term) AS rn
  FROM (SELECT country, source, term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM tok_{tag} GROUP BY ALL HAVING count(*) >= 3)) JOIN size_{tag} USING (country, source) WHERE rn <= 30000),
unit_{tag} AS (SELECT country, source, src, entity_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY country, source, src, entity_id)) AS u
  FROM (SELECT t.*, (1 + ln(tf::DOUBLE)) * idf AS w FROM tok_{tag} t JOIN voc_{tag} USING (country, source, term))),
topk_{tag} AS (SELECT source, source1_entity_id, candidate_id, score FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id, source ORDER BY score DESC, candidate_id) AS rn
  FROM (SELECT a.source, a.entity_id AS source1_entity_id, b.entity_id AS candidate_id, round(sum(a.u * b.u), 9) AS score FROM unit_{tag} a JOIN unit_{tag} b USING (country, source, term)
    WHERE a.src = 'S1' AND b.src <> 'S1' GROUP BY ALL) WHERE score >= 0.05) WHERE rn <= {k})"""


NUMERIC = """
num AS (SELECT country, src, entity_id, unnest(numeric_tokens) AS token FROM norm),
numdf AS (SELECT country, src AS source, token, count(*) AS df FROM num WHERE src <> 'S1' AND length(token) >= 3 GROUP BY ALL),
topk_num AS (SELECT source, source1_entity_id, candidate_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY source1_entity_id, source ORDER BY shared DESC, candidate_id) AS rn
  FROM (SELECT b.src AS source, a.entity_id AS source1_entity_id, b.entity_id AS candidate_id, count(*) AS shared FROM num a JOIN num b ON a.country = b.country AND a.token = b.token
    JOIN numdf d ON d.country = b.country AND d.source = b.src AND d.token = b.token WHERE a.src = 'S1' AND b.src <> 'S1' AND d.df <= 500 GROUP BY ALL)) WHERE rn <= 30)"""
MERGED = """
merged AS (SELECT source, source1_entity_id, candidate_id, max(n) AS name_score, max(a) AS addr_score, max(c) AS shared, round(max(n) + max(a) + 0.1 * least(max(c), 5)::DOUBLE, 9) AS combined FROM (
  SELECT source, source1_entity_id, candidate_id, score AS n, 0::DOUBLE AS a, 0::BIGINT AS c FROM topk_name UNION ALL
  SELECT source, source1_entity_id, candidate_id, 0, score, 0 FROM topk_addr UNION ALL SELECT source, source1_entity_id, candidate_id, 0, 0, shared FROM topk_num) GROUP BY ALL)"""
CAPPED = """
capped AS (SELECT source1_entity_id, candidate_id, name_score, addr_score, (shared > 0)::INT AS numeric_match, source FROM
  (SELECT *, row_number() OVER (PARTITION BY source1_entity_id ORDER BY combined DESC, source, candidate_id) AS rn FROM merged) WHERE rn <= 100)"""
CANDIDATES = """
cand AS (SELECT source1_entity_id, candidate_id, name_score, addr_score, numeric_match, source FROM
  (SELECT *, row_number() OVER (PARTITION BY source1_entity_id, candidate_id ORDER BY round(name_score + addr_score + numeric_match, 9) DESC, source) AS rn FROM capped) WHERE rn = 1)"""
ALL_PASSES = ",".join((NORM, tfidf_sql("name", "name"), tfidf_sql("addr", "addr"), NUMERIC, MERGED, CAPPED, CANDIDATES))
SCORED = "scored AS (SELECT *, round(1 / (1 + exp(-(4 * name_score + 2 * addr_score + numeric_match - 3))), 6) AS proba FROM cand)"
