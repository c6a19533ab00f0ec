import random

import numpy as np

import corpus_pipeline
from tessera.llm import near_copies

DOCS = "doc_id long, text string, lang string"


def sets_of(text):
    return np.unique(near_copies.shingles(text, 5))


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def changed(words, places, rng):
    out = list(words)
    for p in places:
        out[p] = f"v{rng.randrange(10**9)}"
    return " ".join(out)


def test_near_dedup_reaches_similarity(spark):
    """Pairs at and above 0.8 lose the later document, pairs below keep both."""
    rng, texts, want = random.Random(4), [], set()
    for i in range(0, 120, 2):
        words = [f"w{rng.randrange(10**9)}" for _ in range(100 + i)]
        places = [10 * k + 4 for k in range(1, rng.choice((2, 3, 4)))] if i % 4 else [10 * k + 4 for k in range(1, 9)]
        other = changed(words, places, rng)
        texts += [(i, " ".join(words)), (i + 1, other)]
        a, b = (sets_of(t.encode()) for t in (texts[-2][1], other))
        want |= {i} if jaccard(a, b) >= 0.8 else {i, i + 1}
    texts += [(500 + k, "W0 " + " ".join(f"z{j}" for j in range(80)) + "\n") for k in range(40)]
    want |= {500}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts], DOCS)
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got) == sorted(want) and {i for i in want if i % 2} and len(want) < 121
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_walk_verifies_each_pair():
    """Agrees with all pairs of a brute force on chains of texts that drift apart."""
    rng, texts = random.Random(9), []
    for _ in range(6):
        words = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        for _ in range(12):
            texts.append(" ".join(words).encode())
            words[rng.randrange(120)] = f"v{rng.randrange(10**9)}"
    sets = [sets_of(t) for t in texts]
    edges = list(near_copies.walked(sets, [near_copies.bands(s) for s in sets], 0.8))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8}

    def groups(pairs):
        up = list(range(len(sets)))
        for _ in range(len(sets)):
            for a, b in pairs:
                up[a] = up[b] = min(up[a], up[b])
        return up

    assert groups(edges) == groups(want) and all((max(e), min(e)) in want for e in edges)


def test_near_dedup_null_and_repeated_ids(spark):
    """Rows without an id, and rows that share one, stay unless they are copies."""
    rng = random.Random(6)
    said = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(90))
    a, b, c, d, e, f = (said() for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (7, c), (8, d), (8, e), (5, d), (9, f), (9, f), (None, a + " end")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS).coalesce(1)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    want = [(None, a), (None, b), (7, c), (5, d), (8, e), (9, f)]
    assert sorted(map(str, got)) == sorted(map(str, want))
