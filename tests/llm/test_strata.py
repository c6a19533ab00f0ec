from tessera.llm import quality_rules

DOCS = "doc_id long, text string, lang string"


def test_small_strata_are_pooled(spark, monkeypatch):
    """Strata beyond the bound share cutoffs; the largest keep their own."""
    monkeypatch.setattr(quality_rules, "MAX_STRATA", 1)
    words = " ".join(f"w{i}" for i in range(60))
    shout, rows, labels = words.upper(), [], []
    for i in range(12000):
        lang = "big" if i < 6500 else f"s{i % 40}"
        bad = i >= 6500 and i % 11 == 0
        rows.append((i, shout if bad else words, lang))
        labels.append((i, not bad))
    rows += [(12000, shout, "big"), (12001, shout, "s3"), (12002, shout, "new"), (12003, words, "s3")]
    docs, said = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, good boolean")
    got = {r.doc_id: r.kept for r in quality_rules.judged(docs, said).where("doc_id >= 12000").collect()}
    assert got == {12000: True, 12001: False, 12002: False, 12003: True}
    kept = {r.doc_id for r in quality_rules.filter_documents(docs, said).where("doc_id >= 12000").collect()}
    assert kept == {12000, 12003}
