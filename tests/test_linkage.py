import random

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.functions import normalize as n
from tessera.functions import similarity as sim
from tessera.operators import blocking, decide, evaluate, model
from tessera.sources import tables

SF = "/root/testdata/sf0.001"
CHEAP = ("scan_project_filter", "norm_name", "norm_address", "numeric_tokens", "suffix_histogram", "token_doc_freq", "numeric_pass_topk", "tfidf_name_topk", "topk_orders_per_customer", "running_total", "union_distinct_keys")


@pytest.mark.parametrize("name", CHEAP)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF), con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_names(spark):
    rows = [("1", "Café & Co, Ltd", "12-34 Main St.", "x"), ("2", "Limited Brands", "none", "x"), ("3", None, None, "x"), ("4", "ACME Private Limited", "12a Rd", "x"), ("5", "ﬁne ½", "7 Dr", None), ("6", "xltd", "NONE", "x")]
    got = {r["entity_id"]: r for r in n.normalize_records(spark.createDataFrame(rows, tables.RAW)).collect()}
    assert got["1"]["norm_name"] == "cafe and co ltd" and got["1"]["is_non_latin"] and got["1"]["numeric_tokens"] == ["12", "34"]
    assert got["1"]["norm_addr"] == "12 34 main street"
    assert (got["2"]["norm_core"], got["2"]["norm_suffix"], got["2"]["norm_addr"]) == ("brands", "ltd", "")
    assert got["3"]["norm_name"] == "" and not got["3"]["is_non_latin"] and got["3"]["numeric_tokens"] == []
    assert got["4"]["norm_name"] == "acme pvt ltd" and got["4"]["numeric_tokens"] == []
    assert got["5"]["norm_name"] == "fine 1 2" and got["5"]["numeric_tokens"] == []
    assert got["6"]["norm_suffix"] == "" and got["6"]["norm_addr"] == "none"


def test_similarities():
    assert round(sim.jaro_winkler_of("martha", "marhta"), 4) == 0.9611
    assert sim.jaro_winkler_of("", "") == 1 and sim.jaro_winkler_of("", "a") == 0
    assert sim.token_set_of("a b", "a b c") == 1 and sim.token_set_of("", "x") == 0 and sim.token_sort_of("b a", "a b") == 1
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert sim.common_subsequence(a, b) == t[-1][-1]


def test_decision(spark):
    scored = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("a", "z", 0.01), ("b", "x", 0.1)], "source1_entity_id string, candidate_id string, proba double")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "source1_entity_id string")
    got = dict(tuple(r) for r in decide.make_predictions(scored, ids).collect())
    assert got == {"a": "x,y", "b": "", "c": ""}
    flat = dict(tuple(r) for r in decide.make_predictions(scored, ids, use_expected=False, threshold=0.85).collect())
    assert flat["a"] == "x"


def test_evaluation(spark):
    two = "source1_entity_id string, matched_entity_ids string"
    pred = spark.createDataFrame([("a", "x,y"), ("b", ""), ("c", "q")], two)
    truth = spark.createDataFrame([("a", "x"), ("b", None), ("d", "w")], two)
    f = {r["source1_entity_id"]: r["f"] for r in evaluate.f_beta_per_entity(pred, truth).collect()}
    assert f["b"] == 1 and f["c"] == 0 and f["d"] == 0 and round(f["a"], 6) == round(1.25 / 2.25, 6)
    empty = tables.empty_candidates(spark)
    assert evaluate.blocking_recall(empty, truth.limit(0)).first()["recall"] == 1.0
    assert evaluate.reduction_ratio(empty, pred.limit(0), pred).first()["ratio"] == 0.0


def test_sources(spark, tmp_path):
    (tmp_path / "in.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n1\tNA\t"a\tb"\tFR\n2\tnone\t\tNA\n')
    got = [tuple(r) for r in tables.read_tsv(spark, str(tmp_path / "in.tsv")).orderBy("entity_id").collect()]
    assert got == [("1", None, "a\tb", "FR"), ("2", "none", None, None)]
    calls = []
    for config in ({"k": 1}, {"k": 1}, {"k": 2}):
        tables.cached(spark, f"file://{tmp_path}", "stage", config, lambda: calls.append(1) or spark.range(3)).count()
    assert len(calls) == 2


def test_empty_and_folds(spark):
    rows = n.normalize_records(spark.createDataFrame([], tables.RAW)).withColumn("src", model.F.lit("S1"))
    assert blocking.generate_candidates(rows).count() == 0
    ids = spark.range(200).selectExpr("cast(id % 50 as string) source1_entity_id")
    assert model.with_fold(ids).groupBy("source1_entity_id").agg(model.F.countDistinct("fold").alias("k")).where("k > 1").count() == 0
