"""The stages and run() of the corpus pipeline on planted documents."""

import random

import corpus_pipeline
import public_tokenizers
from tessera.llm.common import _left
from tessera.llm.encoding import encoder

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string"


def said(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


def planted(spark, tmp_path):
    """Documents by id, and what each stage is to do with them."""
    rng = random.Random(12)
    item, passage = said(rng, 30), said(rng, 60)
    texts = {i: said(rng, 120) for i in range(30)}
    texts |= {100: texts[3], 101: texts[4].replace(" ", "  "), 102: " ".join(texts[5].split()[:-3])}  # copies
    texts |= {200: f"{said(rng, 60)} {passage} {said(rng, 60)}", 201: f"{said(rng, 70)} {passage} {said(rng, 70)}"}  # a passage of two documents
    texts |= {300: f"{said(rng, 60)} {item} {said(rng, 60)}", 400: "too short", 401: "again and again " * 60}
    rows = [(i, t, "en", "s", len(t), "clash") for i, t in texts.items()]
    rows += [(None, said(rng, 100), "en", "s", 1, None), (None, said(rng, 100), None, None, None, None), (7, said(rng, 90), "en", "s", 2, "other"), (500, None, "en", "s", 0, None), (501, "", "en", "s", 0, None)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (400, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, passage


def test_run(spark, tmp_path):
    rows, passage = planted(spark, tmp_path)
    docs, folder, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    whole = {(i, t) for i, t, *_ in rows}
    bad = {(400, "too short"), *((i, t) for i, t in whole if i in (401, 500, 501))}
    assert set(left["quality_rules"]) == whole - bad
    kept = whole - bad - {(i, t) for i, t in whole if i in (100, 101, 102)}
    assert set(left["near_dedup"]) == kept and len(left["near_dedup"]) == len(kept)
    cut = dict(x for x in left["repeat_removal"] if x[0] not in (None, 7))
    assert passage in cut[200] and passage not in cut[201] and len(cut[201]) < len(dict(whole)[201]) - len(passage) + 1 and cut[300] == dict(whole)[300]
    assert {i for i, _ in left["repeat_removal"]} - {i for i, _ in left["decontamination"]} == {300}
    assert sum(i is None for i, _ in left["decontamination"]) == 2 and sum(i == 7 for i, _ in left["decontamination"]) == 2

    ids = encoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    lengths = sorted(len(ids.encode(t, add_special_tokens=False).ids) + 1 for _, t in left["decontamination"])
    assert sum(p.length for p in pieces) == sum(lengths) and max(p.sequence_length for p in pieces) <= 2048
    same = corpus_pipeline.run(spark, folder).collect()
    assert sorted((p.doc_id or -1, p.start, p.length) for p in same if p.start == 0 and p.length == p.doc_tokens) and sum(p.length for p in same) == sum(lengths)
    assert len(_left) <= 3


def test_empty_documents(spark, tmp_path):
    planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name
        docs = spark.createDataFrame([], docs.schema)
