"""The queries of the linkage operators, each with the SQL that it is checked against where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import blocking as b
from tessera.operators import decide as d
from tessera.operators import evaluate as e
from tessera.operators import features as ft
from tessera.operators import model as m
from tessera.plans import fixtures as fx
from tessera.sources.tables import staged

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | Column) -> Column:
    """Six digits as DuckDB rounds, by the binary product: nine digits that end in 500 are halves, of which some fall otherwise as decimals."""
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6) / 1e6


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with a fixed logistic pseudo-probability."""
    z = 4 * F.col("name_score") + 2 * F.col("addr_score") + F.col("numeric_match") - 3
    return b.generate_candidates(fx.normalized(spark, sf_dir)).withColumn("proba", F.round(1 / (1 + F.exp(-z)), 6))


def first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.er(spark, sf_dir).where("src = 'S1'").select(F.col("entity_id").alias("source1_entity_id"))


# --- scans, normalization ---------------------------------------------------------------------------------


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'fr'")
def scan_project_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("lang") == "fr").select("doc_id", "source", "n_chars")


@query(f"WITH {fx.NORM} SELECT entity_id, norm_core, norm_suffix, norm_name FROM norm")
def norm_name(spark, sf_dir):
    return fx.freshly_normalized(spark, sf_dir).select("entity_id", "norm_core", "norm_suffix", "norm_name")


@query(f"WITH {fx.NORM} SELECT entity_id, norm_addr FROM norm")
def norm_address(spark, sf_dir):
    return fx.freshly_normalized(spark, sf_dir).select("entity_id", "norm_addr")


@query(f"WITH {fx.NORM} SELECT entity_id, unnest(numeric_tokens) AS token FROM norm")
def numeric_tokens(spark, sf_dir):
    return fx.normalized(spark, sf_dir).select("entity_id", F.explode("numeric_tokens").alias("token"))


@query(f"WITH {fx.NORM} SELECT entity_id, is_non_latin FROM norm")
def non_ascii_flag(spark, sf_dir):
    return fx.normalized(spark, sf_dir).select("entity_id", "is_non_latin")


@query(f"WITH {fx.NORM} SELECT norm_suffix, count(*) AS n FROM norm GROUP BY ALL")
def suffix_histogram(spark, sf_dir):
    return fx.normalized(spark, sf_dir).groupBy("norm_suffix").agg(F.count("*").alias("n"))


@query(f"WITH {fx.ER} SELECT country, src, count(*) AS n FROM er GROUP BY ALL")
def country_source_counts(spark, sf_dir):
    return fx.er(spark, sf_dir).groupBy("country", "src").agg(F.count("*").alias("n"))


@query(f"WITH {fx.ER} SELECT DISTINCT country FROM er")
def distinct_countries(spark, sf_dir):
    return fx.er(spark, sf_dir).select("country").distinct()


@query(f"WITH {fx.ER},{fx.TRUTH} SELECT * FROM er_truth")
def truth_lists(spark, sf_dir):
    return fx.er_truth(spark, sf_dir)


# --- blocking ---------------------------------------------------------------------------------------------


@query(f"WITH {fx.NORM},{fx.NUMERIC} SELECT * FROM numdf")
def token_doc_freq(spark, sf_dir):
    return b.number_counts(fx.normalized(spark, sf_dir))


@query(f"WITH {fx.NORM},{fx.NUMERIC} SELECT * FROM topk_num")
def numeric_pass_topk(spark, sf_dir):
    return b.numeric_topk(fx.normalized(spark, sf_dir))


@query(f"WITH {fx.NORM},{fx.tfidf_sql('name', 'name')} SELECT country, source, term, df, ctf, round(idf, 6) AS idf FROM voc_name")
def tfidf_vocab(spark, sf_dir):
    return b.vocabulary(fx.normalized(spark, sf_dir), "norm_name").withColumn("idf", r6("idf"))


@query(f"WITH {fx.NORM},{fx.tfidf_sql('name', 'name')} SELECT country, source, entity_id, count(*) AS n_terms, round(sum(u * u), 6) AS norm2, round(max(u), 6) AS top FROM unit_name GROUP BY ALL")
def tfidf_unit_norms(spark, sf_dir):
    u = b.unit_vectors(fx.normalized(spark, sf_dir), "norm_name")
    return u.groupBy("country", "source", "entity_id").agg(F.count("*").alias("n_terms"), r6(F.sum(F.col("u") * F.col("u"))).alias("norm2"), r6(F.max("u")).alias("top"))


@query(f"WITH {fx.NORM},{fx.tfidf_sql('name', 'name')} SELECT source, source1_entity_id, candidate_id, round(score, 6) AS score FROM topk_name")
def tfidf_name_topk(spark, sf_dir):
    return b.tfidf_topk(fx.normalized(spark, sf_dir), "norm_name", b.TOP_NAME).withColumn("score", r6("score"))


@query(f"WITH {fx.NORM},{fx.tfidf_sql('addr', 'addr')} SELECT source, source1_entity_id, candidate_id, round(score, 6) AS score FROM topk_addr")
def tfidf_addr_topk(spark, sf_dir):
    return b.tfidf_topk(fx.normalized(spark, sf_dir), "norm_addr", b.TOP_ADDR).withColumn("score", r6("score"))


def passes(spark, sf_dir):
    rows = fx.normalized(spark, sf_dir)
    return b.tfidf_topk(rows, "norm_name", b.TOP_NAME), b.tfidf_topk(rows, "norm_addr", b.TOP_ADDR), b.numeric_topk(rows)


@query(f"WITH {fx.ALL_PASSES} SELECT source, source1_entity_id, candidate_id, round(name_score, 6) AS name_score, round(addr_score, 6) AS addr_score, shared, round(combined, 6) AS combined FROM merged")
def candidates_merge(spark, sf_dir):
    return b.merged_passes(*passes(spark, sf_dir)).withColumns({c: r6(c) for c in ("name_score", "addr_score", "combined")})


_CAND = "source1_entity_id, candidate_id, round(name_score, 6) AS name_score, round(addr_score, 6) AS addr_score, numeric_match, source"


@query(f"WITH {fx.ALL_PASSES} SELECT {_CAND} FROM capped")
def candidates_capped(spark, sf_dir):
    return b.capped(b.merged_passes(*passes(spark, sf_dir))).withColumns({c: r6(c) for c in ("name_score", "addr_score")})


@query(f"WITH {fx.ALL_PASSES} SELECT {_CAND} FROM cand")
def candidates_dedup(spark, sf_dir):
    return b.deduplicated(b.capped(b.merged_passes(*passes(spark, sf_dir)))).withColumns({c: r6(c) for c in ("name_score", "addr_score")})


@query(f"WITH {fx.ALL_PASSES} SELECT {_CAND} FROM cand")
def generate_candidates(spark, sf_dir):
    return b.generate_candidates(fx.normalized(spark, sf_dir)).withColumns({c: r6(c) for c in ("name_score", "addr_score")})


_PAIRS = f"{fx.TRUTH}, tp AS (SELECT source1_entity_id, unnest(list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '')) AS candidate_id FROM er_truth)"


@query(f"""WITH {fx.ALL_PASSES},{_PAIRS}, f AS (SELECT source1_entity_id, candidate_id, max(name_score) > 0 AS n, max(addr_score) > 0 AS a, max(shared) > 0 AS c FROM merged GROUP BY ALL)
SELECT count(*) AS n_truth, count(*) FILTER (n) AS after_name, count(*) FILTER (n OR a) AS after_addr, count(*) FILTER (n OR a OR c) AS after_numeric FROM tp LEFT JOIN f USING (source1_entity_id, candidate_id)""")
def pass_recall(spark, sf_dir):
    return b.pass_recall(*passes(spark, sf_dir), e.truth_pairs(fx.er_truth(spark, sf_dir)))


@query(f"WITH {fx.ALL_PASSES},{_PAIRS} SELECT count(*) AS n_truth, count(c.source) AS n_found, CASE WHEN count(*) = 0 THEN 1 ELSE round(count(c.source) / count(*), 6) END AS recall FROM tp LEFT JOIN cand c USING (source1_entity_id, candidate_id)")
def blocking_recall(spark, sf_dir):
    return e.blocking_recall(b.generate_candidates(fx.normalized(spark, sf_dir)), fx.er_truth(spark, sf_dir)).withColumn("recall", r6("recall"))


@query(f"WITH {fx.ALL_PASSES}, c AS (SELECT (SELECT count(*) FROM cand) AS pairs, (SELECT count(*) FROM er WHERE src = 'S1') AS n1, (SELECT count(*) FROM er WHERE src <> 'S1') AS n23) SELECT *, round(1 - pairs / (n1 * n23), 6) AS ratio FROM c")
def reduction_ratio(spark, sf_dir):
    rows = fx.normalized(spark, sf_dir)
    return e.reduction_ratio(b.generate_candidates(rows), rows.where("src = 'S1'"), rows.where("src <> 'S1'")).withColumn("ratio", r6("ratio"))


@query(f"WITH {fx.ALL_PASSES},{_PAIRS}, k AS (SELECT DISTINCT * FROM tp) SELECT source1_entity_id, candidate_id, source, (k.candidate_id IS NOT NULL)::INT AS label FROM cand LEFT JOIN k USING (source1_entity_id, candidate_id)")
def label_candidates(spark, sf_dir):
    return e.label_candidates(b.generate_candidates(fx.normalized(spark, sf_dir)), fx.er_truth(spark, sf_dir)).select("source1_entity_id", "candidate_id", "source", "label")


# --- features ---------------------------------------------------------------------------------------------

_SIDES = f"""{fx.ALL_PASSES}, pairs AS (SELECT c.*, a.norm_name AS n1, a.norm_core AS c1, a.norm_suffix AS s1, a.norm_addr AS a1, a.numeric_tokens AS t1,
  b.norm_name AS n2, b.norm_core AS c2, b.norm_suffix AS s2, b.norm_addr AS a2, b.numeric_tokens AS t2, b.is_non_latin AS l2
  FROM cand c JOIN norm a ON a.entity_id = c.source1_entity_id JOIN norm b ON b.entity_id = c.candidate_id)"""


def pairs(spark, sf_dir, *wanted):
    """Candidates with both sides and the wanted native features, all if none is named."""
    rows = fx.normalized(spark, sf_dir)
    return ft.native_features(ft.joined(b.generate_candidates(rows), rows, wanted or ft.FEATURES), wanted or ft.FEATURES)


def _jac(x: str, y: str) -> str:
    return f"round(CASE WHEN len({x}) = 0 AND len({y}) = 0 THEN 1 WHEN len({x}) = 0 OR len({y}) = 0 THEN 0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END, 6)"


def _grams(c: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({c}) - {n} + 2), lambda i: substr({c}, i, {n})))"


def _toks(c: str) -> str:
    return f"list_distinct(list_filter(string_split({c}, ' '), lambda x: x <> ''))"


@query(f"WITH {_SIDES} SELECT source1_entity_id, candidate_id, CASE WHEN greatest(length(n1), length(n2)) = 0 THEN 1 ELSE round(1 - levenshtein(n1, n2) / greatest(length(n1), length(n2)), 6) END AS levenshtein FROM pairs WHERE NOT regexp_matches(n1 || n2, '[^\\x00-\\x7F]')")
def feat_levenshtein(spark, sf_dir):
    return pairs(spark, sf_dir, "levenshtein").where(~F.concat("s1_norm_name", "cnd_norm_name").rlike(r"[^\x00-\x7F]")).select("source1_entity_id", "candidate_id", r6("levenshtein").alias("levenshtein"))


@query(f"WITH {_SIDES} SELECT source1_entity_id, candidate_id, round(jaro_winkler_similarity(n1, n2), 6) AS jaro_winkler FROM pairs WHERE n1 <> '' AND n2 <> '' AND NOT regexp_matches(n1 || n2, '[^\\x00-\\x7F]')")
def feat_jaro_winkler(spark, sf_dir):
    rows = ft.python_features(pairs(spark, sf_dir)).where((F.col("s1_norm_name") != "") & (F.col("cnd_norm_name") != "") & ~F.concat("s1_norm_name", "cnd_norm_name").rlike(r"[^\x00-\x7F]"))
    return rows.select("source1_entity_id", "candidate_id", r6("jaro_winkler").alias("jaro_winkler"))


@query()
def feat_levenshtein_all(spark, sf_dir):
    """Every pair; feat_levenshtein has those on which DuckDB agrees."""
    return pairs(spark, sf_dir, "levenshtein").select("source1_entity_id", "candidate_id", r6("levenshtein").alias("levenshtein"))


@query()
def feat_jaro_winkler_all(spark, sf_dir):
    """Every pair; feat_jaro_winkler has those on which DuckDB agrees."""
    return ft.python_features(pairs(spark, sf_dir)).select("source1_entity_id", "candidate_id", r6("jaro_winkler").alias("jaro_winkler"))


@query()
def feat_token_ratios(spark, sf_dir):
    return ft.python_features(pairs(spark, sf_dir)).select("source1_entity_id", "candidate_id", "token_set_ratio", "token_sort_ratio")


@query(f"WITH {_SIDES} SELECT source1_entity_id, candidate_id, {_jac(_grams('c1', 3), _grams('c2', 3))} AS char3_jaccard, {_jac(_grams('c1', 4), _grams('c2', 4))} AS char4_jaccard, {_jac(_grams('a1', 3), _grams('a2', 3))} AS addr_char3_jaccard FROM pairs")
def feat_char_jaccard(spark, sf_dir):
    return pairs(spark, sf_dir).select("source1_entity_id", "candidate_id", *[r6(c).alias(c) for c in ("char3_jaccard", "char4_jaccard", "addr_char3_jaccard")])


@query(f"WITH {_SIDES} SELECT source1_entity_id, candidate_id, {_jac(_toks('c1'), _toks('c2'))} AS token_jaccard, {_jac(_toks('a1'), _toks('a2'))} AS addr_token_jaccard FROM pairs")
def feat_token_jaccard(spark, sf_dir):
    return pairs(spark, sf_dir, "token_jaccard", "addr_token_jaccard").select("source1_entity_id", "candidate_id", *[r6(c).alias(c) for c in ("token_jaccard", "addr_token_jaccard")])


@query(f"WITH {_SIDES} SELECT source1_entity_id, candidate_id, (c1 <> '' AND c2 <> '' AND split_part(c1, ' ', 1) = split_part(c2, ' ', 1))::INT AS first_token_eq FROM pairs")
def feat_first_token(spark, sf_dir):
    return pairs(spark, sf_dir).select("source1_entity_id", "candidate_id", "first_token_eq")


_ZIP = "list_filter({}, lambda x: length(x) IN (5, 6))"


@query(f"WITH {_SIDES} SELECT source1_entity_id, candidate_id, {_jac('t1', 't2')} AS numeric_jaccard, list_has_any(t1, t2)::INT AS numeric_overlap, list_has_any({_ZIP.format('t1')}, {_ZIP.format('t2')})::INT AS zip_match FROM pairs")
def feat_numeric(spark, sf_dir):
    return pairs(spark, sf_dir).select("source1_entity_id", "candidate_id", r6("numeric_jaccard").alias("numeric_jaccard"), "numeric_overlap", "zip_match")


@query(f"WITH {_SIDES} SELECT source1_entity_id, candidate_id, (s1 <> '' AND s2 <> '' AND s1 <> s2)::INT AS suffix_conflict, (s1 <> '' AND s1 = s2)::INT AS suffix_match, l2::INT AS is_non_latin, (a1 = '')::INT AS s1_addr_empty, (a2 = '')::INT AS cnd_addr_empty FROM pairs")
def feat_suffix_flags(spark, sf_dir):
    flags = ("suffix_conflict", "suffix_match", "is_non_latin", "s1_addr_empty", "cnd_addr_empty")
    return pairs(spark, sf_dir, *flags).select("source1_entity_id", "candidate_id", *flags)


@query(f"WITH {fx.ALL_PASSES} SELECT source1_entity_id, candidate_id, round(name_score, 6) AS blk_name_score, round(addr_score, 6) AS blk_addr_score, numeric_match AS blk_num_match, (source = 'S2')::INT AS is_s2, round(round(name_score + addr_score + 0.5::DOUBLE * numeric_match, 9), 6) AS combined_score FROM cand")
def feat_blocking(spark, sf_dir):
    return ft.candidate_features(b.generate_candidates(fx.normalized(spark, sf_dir))).select("source1_entity_id", "candidate_id", r6("blk_name_score").alias("blk_name_score"), r6("blk_addr_score").alias("blk_addr_score"), "blk_num_match", "is_s2", r6("combined_score").alias("combined_score"))


@query(f"WITH {fx.ALL_PASSES}, s AS (SELECT *, round(name_score + addr_score + 0.5::DOUBLE * numeric_match, 9) AS cs FROM cand) SELECT source1_entity_id, candidate_id, row_number() OVER (PARTITION BY source1_entity_id ORDER BY cs DESC, candidate_id)::DOUBLE AS cand_rank, round(max(cs) OVER (PARTITION BY source1_entity_id) - cs, 6) AS score_gap_to_rank1, count(*) OVER (PARTITION BY source1_entity_id) AS n_candidates FROM s")
def feat_context_windows(spark, sf_dir):
    return ft.candidate_features(b.generate_candidates(fx.normalized(spark, sf_dir))).select("source1_entity_id", "candidate_id", "cand_rank", r6("score_gap_to_rank1").alias("score_gap_to_rank1"), "n_candidates")


@query()
def all_features(spark, sf_dir):
    rows = fx.normalized(spark, sf_dir)
    return ft.compute_features(b.generate_candidates(rows), rows)


# --- decisions, evaluation --------------------------------------------------------------------------------

_PREFIX = f"""{fx.ALL_PASSES},{fx.SCORED},
pre AS (SELECT *, row_number() OVER w AS m, sum(proba) OVER (PARTITION BY source1_entity_id ORDER BY proba DESC, candidate_id ROWS UNBOUNDED PRECEDING) AS cum, sum(proba) OVER (PARTITION BY source1_entity_id) AS total,
  max(proba) OVER (PARTITION BY source1_entity_id) AS best FROM scored WINDOW w AS (PARTITION BY source1_entity_id ORDER BY proba DESC, candidate_id)),
fm AS (SELECT *, CASE WHEN total <= 0 THEN 0 ELSE round(1.25::DOUBLE * cum / (0.25::DOUBLE * total + m), 9) END AS f FROM pre)"""
_CHOSEN = f"""{_PREFIX}, top AS (SELECT *, max(f) OVER (PARTITION BY source1_entity_id) AS tf FROM fm WHERE best >= 0.2),
chosen AS (SELECT * FROM (SELECT *, min(CASE WHEN f = tf THEN m END) OVER (PARTITION BY source1_entity_id) AS bm FROM top) WHERE m <= bm AND tf > 0),
ids AS (SELECT entity_id AS source1_entity_id FROM er WHERE src = 'S1'),
pred AS (SELECT source1_entity_id, coalesce(string_agg(candidate_id, ',' ORDER BY m), '') AS matched_entity_ids FROM ids LEFT JOIN chosen USING (source1_entity_id) GROUP BY ALL)"""


@query(f"WITH {_PREFIX} SELECT source1_entity_id, candidate_id, m, round(cum, 6) AS cum, round(total, 6) AS total, round(f, 6) AS f FROM fm")
def expected_fbeta_prefix(spark, sf_dir):
    return d.expected_prefix(scored(spark, sf_dir)).select("source1_entity_id", "candidate_id", "m", r6("cum").alias("cum"), r6("total").alias("total"), r6("f").alias("f"))


@query(f"WITH {_CHOSEN} SELECT source1_entity_id, candidate_id, m FROM chosen")
def decide_expected(spark, sf_dir):
    return d.decide(scored(spark, sf_dir)).select("source1_entity_id", "candidate_id", "m")


@query(f"WITH {_PREFIX} SELECT source1_entity_id, candidate_id, m FROM fm WHERE best >= 0.2 AND proba >= 0.5")
def decide_threshold(spark, sf_dir):
    return d.decide(scored(spark, sf_dir), use_expected=False).select("source1_entity_id", "candidate_id", "m")


@query(f"WITH {_PREFIX} SELECT source1_entity_id, count(*) AS n FROM fm WHERE best >= 0.5 GROUP BY ALL")
def singleton_gate(spark, sf_dir):
    return d.gate(scored(spark, sf_dir), 0.5).groupBy("source1_entity_id").agg(F.count("*").alias("n"))


@query(f"WITH {_CHOSEN} SELECT * FROM pred")
def matching_output(spark, sf_dir):
    return d.make_predictions(scored(spark, sf_dir), first_ids(spark, sf_dir))


@query(f"WITH {_CHOSEN} SELECT source1_entity_id, coalesce(string_agg(candidate_id, ',' ORDER BY candidate_id), '') AS candidate_entity_ids FROM ids LEFT JOIN cand USING (source1_entity_id) GROUP BY ALL")
def candidate_pairs_output(spark, sf_dir):
    return d.candidate_lists(b.generate_candidates(fx.normalized(spark, sf_dir)), first_ids(spark, sf_dir))


_PER = f"""{_CHOSEN},{fx.TRUTH}, sets AS (SELECT source1_entity_id, list_distinct(list_filter(string_split(p.matched_entity_ids, ','), lambda x: x <> '')) AS p, list_distinct(list_filter(string_split(t.matched_entity_ids, ','), lambda x: x <> '')) AS t
  FROM pred p JOIN er_truth t USING (source1_entity_id)), sizes AS (SELECT source1_entity_id, len(list_intersect(p, t)) AS tp, len(p) AS n_pred, len(t) AS n_true FROM sets),
per AS (SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * n_true + n_pred) END AS f FROM sizes)"""


@query(f"WITH {_PER} SELECT source1_entity_id, tp, n_pred, n_true, round(f, 6) AS f FROM per")
def fbeta_per_entity(spark, sf_dir):
    return e.f_beta_per_entity(matching_output(spark, sf_dir), fx.er_truth(spark, sf_dir)).withColumn("f", r6("f"))


@query(f"WITH {_PER} SELECT round(avg(f), 6) AS macro_f, count(*) AS n FROM per")
def macro_fbeta(spark, sf_dir):
    return e.macro_f_beta(matching_output(spark, sf_dir), fx.er_truth(spark, sf_dir)).withColumn("macro_f", r6("macro_f"))


@query(f"WITH {_CHOSEN} SELECT count(*) AS n, count(*) FILTER (matched_entity_ids <> '') AS n_matched, count(*) FILTER (matched_entity_ids = '') AS n_single, (SELECT count(*) FROM chosen) AS n_links FROM pred")
def run_summary(spark, sf_dir):
    return e.summary(matching_output(spark, sf_dir))


@query(f"""WITH {fx.ALL_PASSES},{fx.SCORED},{_PAIRS}, k AS (SELECT DISTINCT * FROM tp), lab AS (SELECT s.*, (k.candidate_id IS NOT NULL)::INT AS label FROM scored s LEFT JOIN k USING (source1_entity_id, candidate_id)),
per AS (SELECT t.i / 100::DOUBLE AS threshold, source1_entity_id, count(*) FILTER (label = 1 AND proba >= t.i / 100::DOUBLE) AS tp, count(*) FILTER (proba >= t.i / 100::DOUBLE) AS n_pred, sum(label) AS n_true FROM lab, range(5, 96) t(i) GROUP BY ALL)
SELECT threshold, round(avg(CASE WHEN n_true = 0 AND n_pred = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE 1.25::DOUBLE * tp / (0.25::DOUBLE * n_true + n_pred) END), 6) AS macro_f FROM per GROUP BY ALL""")
def threshold_grid(spark, sf_dir):
    return m.threshold_scores(e.label_candidates(scored(spark, sf_dir), fx.er_truth(spark, sf_dir))).withColumn("macro_f", r6("macro_f"))


# --- sampling, model --------------------------------------------------------------------------------------


def _drawn(*keys: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '42', {', '.join(keys)})), 1, 15))::BIGINT"


@query(f"WITH {fx.ER} SELECT entity_id AS source1_entity_id FROM er WHERE src = 'S1' ORDER BY {_drawn('entity_id')}, entity_id LIMIT 100")
def seeded_sample(spark, sf_dir):
    """A sampling operator: the limit is the feature."""
    return m.seeded_sample(first_ids(spark, sf_dir), "source1_entity_id", 100)


@query(f"WITH {fx.ER} SELECT ({_drawn('entity_id')} % 5)::INT AS fold, count(*) AS n FROM er WHERE src = 'S1' GROUP BY ALL")
def group_folds(spark, sf_dir):
    return m.with_fold(first_ids(spark, sf_dir)).groupBy("fold").agg(F.count("*").alias("n"))


def labelled(spark, sf_dir):
    return e.label_candidates(scored(spark, sf_dir), fx.er_truth(spark, sf_dir))


@query(f"""WITH {fx.ALL_PASSES},{_PAIRS}, k AS (SELECT DISTINCT * FROM tp), lab AS (SELECT c.*, (k.candidate_id IS NOT NULL)::INT AS label FROM cand c LEFT JOIN k USING (source1_entity_id, candidate_id)),
s AS (SELECT sum(label)::DOUBLE AS pos, sum(1 - label)::DOUBLE AS neg FROM lab)
SELECT label, count(*) AS n FROM lab, s WHERE label = 1 OR {_drawn('source1_entity_id', 'candidate_id')} < floor(least(1, 10 * pos / neg) * 1152921504606846976)::BIGINT GROUP BY ALL""")
def neg_downsample(spark, sf_dir):
    return m.downsampled(labelled(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@query()
def gbt_scores(spark, sf_dir):
    rows = fx.normalized(spark, sf_dir)
    cands = staged(b.generate_candidates(rows), "candidates")
    feats = ft.compute_features(cands, rows).join(e.label_candidates(cands, fx.er_truth(spark, sf_dir)).select("source1_entity_id", "candidate_id", "label"), ["source1_entity_id", "candidate_id"])
    _, out, _ = m.train(feats)
    return out


@query()
def pipeline_end_to_end(spark, sf_dir):
    from tessera.plans.pipeline import link

    return link(fx.er(spark, sf_dir).drop("text"), fx.er_truth(spark, sf_dir))


# --- the operators on the star schema ---------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_orders_per_customer(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query("SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def customer_orders_left_join_listagg(spark, sf_dir):
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("orders"))
    return table(spark, sf_dir, "customer").join(lists, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit("")).alias("orders"))


@query("SELECT o_orderkey, round(max(o_totalprice) OVER (PARTITION BY o_custkey) - o_totalprice, 2) AS gap FROM orders")
def order_gap_to_max(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.max("o_totalprice").over(Window.partitionBy("o_custkey")) - F.col("o_totalprice"), 2).alias("gap"))


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM lineitem")
def running_total(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 2).alias("running"))


@query("SELECT l_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def dedup_keep_first(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("l_orderkey", "l_partkey", "l_extendedprice")


@query("SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders")
def union_distinct_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).union(table(spark, sf_dir, "orders").select("o_custkey")).distinct()


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).intersect(table(spark, sf_dir, "orders").select("o_custkey"))
