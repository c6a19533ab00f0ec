"""Cases that grown tables brought up."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import similarity as sim
from tessera.operators import cosine, features
from tessera.plans import catalogue


@pytest.fixture
def documents(spark, tmp_path):
    """Writes texts as a documents table; gives its folder and a DuckDB connection that sees it."""

    def write(texts, langs=("en",)):
        rows = [(i, x, langs[i % len(langs)], "web", len(x)) for i, x in enumerate(texts, 1)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        return str(tmp_path), con

    return write


def against_sql(spark, name, folder, con):
    got, want = entry.queries()[name](spark, folder), con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    return sorted(str(tuple(r[c] for c in names)) for r in got.collect()), sorted(map(str, want.fetchall()))


def test_street_words_beside_other_letters(spark, documents):
    """A street word beside a letter outside ASCII is replaced, as in the SQL; one inside an ASCII word is not."""
    folder, con = documents([f"a b c d e f {x} y z" for x in ("einßst", "stßkeit", "chßdr", "best", "st_a", "rd", "straßerd", "1st")])
    got, want = against_sql(spark, "norm_address", folder, con)
    assert got == want and any("einßstreet" in x for x in got) and any("best " in x for x in got)


def test_halves_are_rounded_as_in_sql(spark):
    values = [i / 1e9 for i in range(500, 1_000_000_000, 9_999_000)] + [0.2564345, 0.5178465, -0.2564345]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(catalogue.r6("v")).collect()]
    assert got == [duckdb.execute("select round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]


def test_best_by_cosine_in_blocks(spark, documents, monkeypatch):
    """A term that all records hold makes no row a pair; blocks, ties and copies give what the SQL does."""
    monkeypatch.setattr(cosine, "LEFT", 7)
    monkeypatch.setattr(cosine, "RIGHT", 90)
    rng = random.Random(3)
    texts = [" ".join(["all", *(rng.choice("red green blue grey pink teal".split()) for _ in range(rng.randint(0, 9)))]) for _ in range(400)]
    folder, con = documents([*texts, *["the very same words here"] * 120], ("en", "fr"))
    for name in ("tfidf_name_topk", "tfidf_addr_topk", "candidate_pairs_output"):
        got, want = against_sql(spark, name, folder, con)
        assert got == want and got
    found = catalogue.QUERIES["tfidf_name_topk"](spark, folder)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan


def test_features_move_little(spark, documents):
    """Pairs are not shuffled by names for the string similarities; the features equal the SQL's."""
    rng = random.Random(4)
    folder, con = documents([" ".join(rng.choice("red green blü grey pink teal st 12345 a".split()) for _ in range(rng.randint(1, 12))) for _ in range(90)])
    for name in ("feat_char_jaccard", "feat_numeric", "feat_context_windows"):
        got, want = against_sql(spark, name, folder, con)
        assert got == want and got
    plan = catalogue.QUERIES["all_features"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [s1_norm_name" not in plan and "Join [cnd_norm_name" not in plan


def test_texts_not_sets_go_with_pairs(spark, documents):
    """Sets of characters of S1 records are made where pairs are compared; what needs no side joins none."""
    rng = random.Random(5)
    folder, con = documents([" ".join("".join(rng.choice("ab\U0001f600日ü1") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 11))) for _ in range(60)])
    for name in ("feat_char_jaccard", "feat_token_jaccard", "feat_first_token", "feat_suffix_flags", "feat_blocking"):
        got, want = against_sql(spark, name, folder, con)
        assert got == want and got
    sent = lambda name: [x for x in str(catalogue.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan()).splitlines() if "Exchange" in x or "Join" in x or "Scan parquet" in x]
    assert not any("norm_core" in x for x in sent("feat_context_windows"))
    wide = [x for x in sent("feat_char_jaccard") if "Scan parquet" in x and "n_core3" in x]
    assert len(wide) == 2 and sum("addr3" in x.replace("n_addr3", "") for x in wide) == 1


#: Of feature queries: the sets of a record that they need.
NEEDED = {
    "feat_levenshtein": set(),
    "feat_levenshtein_all": set(),
    "feat_suffix_flags": set(),
    "feat_token_jaccard": {"core_tokens", "addr_tokens"},
}


@pytest.mark.parametrize("name", NEEDED)
def test_only_needed_sets_are_made(spark, documents, monkeypatch, name):
    """A feature query makes and writes the sets of its own features and no others; every pair is there, as the SQL has it."""
    rng = random.Random(6)
    folder, con = documents([" ".join(rng.choice("red green blü grey pink teal 日本 st 12345 a".split()) for _ in range(rng.randint(1, 12))) for _ in range(90)] + ["the same words"] * 5)
    made, write = [], features.staged
    monkeypatch.setattr(features, "staged", lambda df, to: (made.extend(df.columns), write(df, to))[1])
    found = catalogue.QUERIES[name](spark, folder)
    assert {c.removeprefix("n_") for c in made} & set(features.LISTS) == NEEDED[name]
    if name in entry.oracle_sql():
        got, want = against_sql(spark, name, folder, con)
        assert got == want and got
    else:
        pairs = catalogue.QUERIES["feat_context_windows"](spark, folder)
        assert sorted(map(tuple, found.select("source1_entity_id", "candidate_id").collect())) == sorted(tuple(r)[:2] for r in pairs.collect())


def test_equal_names_need_no_distance(spark):
    """Equal names are told without a distance; others, empty and null ones are as before."""
    rows = [("acme", "acme"), ("", ""), ("", "a"), ("日本", "日x"), ("abc", "xyz"), (None, "a"), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", sim.levenshtein_similarity(F.col("a"), F.col("b")).alias("l"))
    assert [r.l for r in df.collect()] == [1.0, 1.0, 0.0, 0.5, 0.0, None, 1.0, None]
    plan = str(df._jdf.queryExecution().optimizedPlan())
    assert 0 < plan.index("= b#") < plan.index("levenshtein")
