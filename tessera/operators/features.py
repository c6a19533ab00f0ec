"""Pair features."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.sources.tables import staged

#: The features' names and order.
FEATURES = (
    "jaro_winkler", "levenshtein", "token_set_ratio", "token_sort_ratio", "char3_jaccard", "char4_jaccard", "token_jaccard",
    "first_token_eq", "suffix_conflict", "suffix_match", "is_non_latin", "numeric_jaccard", "numeric_overlap", "addr_token_jaccard",
    "addr_char3_jaccard", "zip_match", "s1_addr_empty", "cnd_addr_empty", "blk_name_score", "blk_addr_score", "blk_num_match",
    "is_s2", "combined_score", "cand_rank", "score_gap_to_rank1", "n_candidates",
)
SIDE = ("norm_name", "norm_core", "norm_suffix", "norm_addr", "numeric_tokens", "is_non_latin")
#: Lists that the pair features compare, by side's column: of candidates, a record's are made once; S1 records' are made of the
#: text in each pair, as only texts and sizes are sent with the pairs.
LISTS = {
    "core3": ("norm_core", lambda c: sim.windows(c, 3)), "core4": ("norm_core", lambda c: sim.windows(c, 4)), "core_tokens": ("norm_core", sim.words),
    "addr3": ("norm_addr", lambda c: sim.windows(c, 3)), "addr_tokens": ("norm_addr", sim.words),
}
#: The features that compare them.
ALIKE = {"char3_jaccard": "core3", "char4_jaccard": "core4", "token_jaccard": "core_tokens", "addr_token_jaccard": "addr_tokens", "addr_char3_jaccard": "addr3"}


def none() -> Column:
    return F.array().cast("array<string>")


def lists_of(wanted: Collection[str]) -> dict:
    """Those of LISTS that the wanted features compare."""
    return {c: LISTS[c] for f, c in ALIKE.items() if f in wanted}


def side(records: DataFrame, key: str, prefix: str, sets: dict, lists: bool) -> DataFrame:
    """A row for each record: SIDE, the sizes of its sets (n_core3 and so on) and, if asked, the sets. With sets, it is
    written once; without any, records only move to where they are joined."""
    fill = {"numeric_tokens": none(), "is_non_latin": F.lit(False)}
    whole = records.dropDuplicates(["entity_id"]).select("entity_id", *[F.coalesce(F.col(c), fill.get(c, F.lit(""))).alias(c) for c in SIDE])
    if sets:
        whole = whole.withColumns({c: F.array_distinct(f(F.col(of))) for c, (of, f) in sets.items()}).withColumns({f"n_{c}": F.size(c) for c in sets})
        whole = staged(whole if lists else whole.drop(*sets), "sides")
    return whole.select(F.col("entity_id").alias(key), *[F.col(c).alias(f"{prefix}_{c}") for c in whole.columns if c != "entity_id"])


def joined(candidates: DataFrame, records: DataFrame, wanted: Collection[str] = FEATURES) -> DataFrame:
    """Candidates with what the wanted features need of both sides; a missing side counts as empty. The S1 side
    comes first, where pairs lie by it already."""
    sets = lists_of(wanted)
    out = candidates.join(side(records.where("src = 'S1'"), "source1_entity_id", "s1", sets, False), "source1_entity_id", "left").join(side(records.where("src <> 'S1'"), "candidate_id", "cnd", sets, True), "candidate_id", "left")
    empty = {"numeric_tokens": none(), "is_non_latin": F.lit(False)} | dict.fromkeys(sets, none()) | {f"n_{c}": F.lit(0) for c in sets}
    return out.withColumns({f"{p}_{c}": F.coalesce(F.col(f"{p}_{c}"), empty.get(c, F.lit(""))) for p, extra in (("s1", ()), ("cnd", sets)) for c in (*SIDE, *[f"n_{x}" for x in sets], *extra)})


def native_features(pairs: DataFrame, wanted: Collection[str] = FEATURES) -> DataFrame:
    """P2, P5-P14, those wanted: everything of both sides that needs no Python."""
    a, b = (lambda c: F.col(f"s1_{c}")), (lambda c: F.col(f"cnd_{c}"))
    both = (a("norm_suffix") != "") & (b("norm_suffix") != "")

    shared = {c: F.array_intersect(b(c), f(a(of))) for c, (of, f) in lists_of(wanted).items()} | {"numbers": F.array_intersect(a("numeric_tokens"), b("numeric_tokens"))}
    # a step of its own: the formula names each count twice, and it would be made twice
    counted = pairs.withColumns({f"__{c}": F.size(x) for c, x in shared.items()})
    made = {f: sim.jaccard_of(F.col(f"__{c}"), a(f"n_{c}"), b(f"n_{c}")) for f, c in ALIKE.items()} | {
        "levenshtein": sim.levenshtein_similarity(a("norm_name"), b("norm_name")),
        "first_token_eq": sim.first_token_equal(a("norm_core"), b("norm_core")),
        "suffix_conflict": (both & (a("norm_suffix") != b("norm_suffix"))).cast("int"),
        "suffix_match": (both & (a("norm_suffix") == b("norm_suffix"))).cast("int"),
        "is_non_latin": b("is_non_latin").cast("int"),
        "numeric_jaccard": sim.jaccard_of(F.col("__numbers"), F.size(a("numeric_tokens")), F.size(b("numeric_tokens"))),
        "numeric_overlap": F.arrays_overlap(a("numeric_tokens"), b("numeric_tokens")).cast("int"),
        "zip_match": F.arrays_overlap(sim.zips(a("numeric_tokens")), sim.zips(b("numeric_tokens"))).cast("int"),
        "s1_addr_empty": (a("norm_addr") == "").cast("int"), "cnd_addr_empty": (b("norm_addr") == "").cast("int"),
    }
    return counted.withColumns({f: x for f, x in made.items() if f in wanted}).drop(*[f"__{c}" for c in shared])


def candidate_features(candidates: DataFrame) -> DataFrame:
    """Those that need neither side. Windows are over all candidates of an S1 record, before texts are
    joined to them: pairs lie by their S1 record then, and nothing wide is sorted."""
    all_ = Window.partitionBy("source1_entity_id")
    return candidates.withColumns({
        "blk_name_score": F.col("name_score"), "blk_addr_score": F.col("addr_score"), "blk_num_match": F.col("numeric_match"),
        "is_s2": (F.col("source") == "S2").cast("int"),
        "combined_score": F.round(F.col("name_score") + F.col("addr_score") + 0.5 * F.col("numeric_match"), 9),
    }).withColumns({
        "cand_rank": F.row_number().over(all_.orderBy(F.desc("combined_score"), "candidate_id")).cast("double"),
        "score_gap_to_rank1": F.max("combined_score").over(all_) - F.col("combined_score"),
        "n_candidates": F.count("*").over(all_),
    })


def python_features(pairs: DataFrame) -> DataFrame:
    """Only pairs of different, non-empty names are compared in Python, equal ones of a batch once; the
    others go there as nulls."""
    a, b = F.col("s1_norm_name"), F.col("cnd_norm_name")
    differ, same = (a != b) & (a != "") & (b != ""), (a == b).cast("double")
    told = lambda f, other: F.when(differ, f(F.when(differ, a), F.when(differ, b))).otherwise(other)
    return pairs.withColumns({"jaro_winkler": told(sim.jaro_winkler, same), "token_set_ratio": told(sim.token_set_ratio, F.when(a == "", 0.0).otherwise(same)), "token_sort_ratio": told(sim.token_sort_ratio, same)})


def compute_features(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """P20: the two keys, source and the 26 features."""
    native = native_features(joined(candidate_features(candidates), records))
    keep = [c for c in FEATURES if c not in ("jaro_winkler", "token_set_ratio", "token_sort_ratio")]
    pairs = python_features(native.select("source1_entity_id", "candidate_id", "source", "s1_norm_name", "cnd_norm_name", *keep))
    return pairs.select("source1_entity_id", "candidate_id", "source", *FEATURES)
