"""Writers, models, the stream and the SQL functions: what is written is read back alike."""

import random

import pytest

from tessera.functions import similarity as sim
from tessera.functions.normalize import normalize_records
from tessera.operators import model
from tessera.plans import pipeline
from tessera.session import session, shared_folder
from tessera.sources import tables
from tessera.streaming import normalized_stream

RECORDS = [("1", "Café & Co, Ltd", "12 Main St", "FR"), ("2", 'say "hi"\tnow', "7 Rd", "US"), ("3", None, None, "FR"), ("4", "Żółw ﬁne", "none", None)]


def test_parquet_by_country(spark, tmp_path):
    df = spark.createDataFrame(RECORDS, tables.RAW)
    tables.write_parquet(df, f"{tmp_path}/t", by_country=True)
    some = tables.read_columns(spark, f"{tmp_path}/t", ["entity_id", "business_name"], country="FR")
    assert sorted(map(tuple, some.collect()), key=str) == [("1", "Café & Co, Ltd"), ("3", None)]
    assert "PartitionFilters: [isnotnull(country" in some._jdf.queryExecution().toString() and "business_address" not in some._jdf.queryExecution().executedPlan().toString()
    tables.write_parquet(df, f"{tmp_path}/u")
    assert sorted(map(tuple, tables.read_columns(spark, f"{tmp_path}/u").collect())) == sorted(RECORDS)


def test_tsv_outputs(spark, tmp_path):
    """Lists with empty ones, quotes and tabs survive; line breaks too, if asked for."""
    lists = [("a", "x,y"), ("b", ""), ("c", 'q"r'), ("d", "u\tv")]
    tables.write_tsv(spark.createDataFrame(lists, tables.TRUTH), f"{tmp_path}/lists", single=True)
    got = tables.read_tsv(spark, f"{tmp_path}/lists", tables.TRUTH)
    assert sorted(map(tuple, got.collect())) == [("a", "x,y"), ("b", None), ("c", 'q"r'), ("d", "u\tv")]
    tables.write_tsv(spark.createDataFrame([("e", "one\ntwo")], tables.TRUTH), f"{tmp_path}/broken")
    assert [tuple(r) for r in tables.read_tsv(spark, f"{tmp_path}/broken", tables.TRUTH, line_breaks=True).collect()] == [("e", "one\ntwo")]


def test_stream_equals_batch(spark, tmp_path):
    tables.write_tsv(spark.createDataFrame([*RECORDS, ("5", "NA", "n/a", "US")], tables.RAW), f"{tmp_path}/in")
    query = normalized_stream(spark, f"{tmp_path}/in").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(120)
    want = normalize_records(tables.read_tsv(spark, f"{tmp_path}/in"))
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_sql_functions(spark):
    sim.register(spark)
    got = spark.sql("SELECT jaro_winkler('martha', 'marhta') AS a, token_sort_ratio('b a', 'a b') AS b, token_set_ratio('a b', 'a b c') AS c").first()
    assert (round(got.a, 4), got.b, got.c) == (0.9611, 1.0, 1.0)


def labelled(spark, n=400):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        label = int(i % 6 == 0)
        rows.append((f"s{i // 4}", f"c{i}", label, *(rng.random() + (2 * label if k % 3 == 0 else 0) for k in range(len(model.FEATURES)))))
    return spark.createDataFrame(rows, "source1_entity_id string, candidate_id string, label int, " + ", ".join(f"{f} double" for f in model.FEATURES))


def test_model(spark, tmp_path):
    """Trained trees tell held-out rows apart, stop before their limit, and give the same scores once read back."""
    rows = labelled(spark)
    found, out, threshold = model.train(rows, folds=2, trees=12, depth=3)
    scored = out.collect()
    assert len(scored) == rows.count() and min(r.proba for r in scored if r.label) > max(r.proba for r in scored if not r.label) - 0.2
    model.save_model(found, threshold, f"{tmp_path}/m")
    again, same = model.load_model(spark, f"{tmp_path}/m")
    told = lambda x: sorted((r.candidate_id, r.proba) for r in model.predict_proba(x, rows).collect())
    assert same == threshold and told(again) == told(found) and found.getNumTrees <= 12


def test_early_stopping(spark):
    """Labels without a pattern: the held rows are predicted no better, so growth stops."""
    rng = random.Random(3)
    rows = labelled(spark, 300).collect()
    noise = spark.createDataFrame([(*r[:2], int(rng.random() < 0.5), *r[3:]) for r in rows], labelled(spark, 1).schema)
    held = noise.where("cast(substring(candidate_id, 2) as int) % 3 = 0")
    assert model._fit(noise.subtract(held), held, 40, 3, 1).getNumTrees < 40


def test_train_and_apply(spark, monkeypatch):
    """A model learnt from one set of records names the matches of another."""
    rng = random.Random(5)

    def records(n, tag):
        out = []
        for i in range(n):
            name, addr = " ".join(rng.choice(["red", "blue", "iron", "oak", "sun", "lake", "moon", "hill"]) for _ in range(3)) + f" {tag}{i}", f"{100 + i} main st {20000 + i}"
            out += [(f"{tag}a{i}", "US", "S1", name, addr), (f"{tag}b{i}", "US", "S2", name + " ltd", addr), (f"{tag}c{i}", "US", "S3", name, None)]
        return spark.createDataFrame(out, "entity_id string, country string, src string, business_name string, business_address string")

    first, second = records(40, "x"), records(15, "y")
    truth = spark.createDataFrame([(f"xa{i}", f"xb{i},xc{i}") for i in range(40)], tables.TRUTH)
    found, out, threshold = pipeline.learn(first, truth, folds=2, trees=5, depth=3)
    got = {r[0]: set(r[1].split(",")) for r in pipeline.apply(found, threshold, second).collect()}
    assert len(got) == 15 and sum(f"yb{i}" in got[f"ya{i}"] for i in range(15)) >= 12


def test_sessions(spark):
    assert session().conf.get("spark.sql.adaptive.enabled") == "true" and shared_folder(spark) == shared_folder(spark)

    class Far:
        conf = type("", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="share"):
        shared_folder(Far)
