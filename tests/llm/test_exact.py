"""Operators against brute force, and the cases of their docstrings."""

import itertools
import random

import numpy as np

from tessera.llm import decontaminate, quality_model, quality_rules


def overlaps(ids, item, overlap, similarity):
    """The longest stretch, over all diagonals, that ends with a match and agrees enough."""
    best = 0
    for diagonal in range(-len(item) + 1, len(ids)):
        same = [0 <= q + diagonal < len(ids) and ids[q + diagonal] == w for q, w in enumerate(item)]
        for a in range(len(item)):
            for b in range(a + min(overlap, len(item)), len(item) + 1):
                inside = 0 <= a + diagonal and b + diagonal <= len(ids)
                if inside and same[b - 1] and sum(same[a:b]) >= similarity * (b - a) - 1e-9:
                    best = max(best, b - a)
    return best


def test_hits_are_all_seed_matches():
    rng = random.Random(4)
    items = [(i, [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 9))]) for i in range(30)]
    block = decontaminate.Block(items, 13, 0.8)
    docs = [[rng.choice([b"a", b"b", b"c", b"d", b"e"]) for _ in range(rng.randint(0, 30))] for _ in range(40)]
    ids, ends = np.array([block.vocabulary.get(w, 0) for x in docs for w in x]), np.cumsum([len(x) for x in docs])
    want = set()
    for mask, (k, (_, t)) in itertools.product(block.masks, enumerate(block.items)):
        if mask in decontaminate.MASKS or len(t) == len(mask):
            for q, (begin, end) in itertools.product(range(len(t) - len(mask) + 1), zip(ends - [len(x) for x in docs], ends)):
                want |= {(k, int(p - q)) for p in range(begin, end - len(mask) + 1) if all(t[q + o] == ids[p + o] for o, on in enumerate(mask) if on)}
    assert set(block.hits(ids, ends)) == want and len(want) > 300


def test_substitutions_are_found():
    """Every one or two changed tokens of items of 5 to 16 tokens: what the definition calls an overlap is found."""
    for n in (5, 9, 13, 16):
        item = [b"t%d" % i for i in range(n)]
        block = decontaminate.Block([(7, item)], 13, 0.8)
        for changed in [(), *itertools.combinations(range(n), 1), *itertools.combinations(range(n), 2)]:
            doc = [b"u", b"v", *(b"new" if i in changed else w for i, w in enumerate(item)), b"w"]
            ids = np.array([block.vocabulary.get(w, 0) for w in doc])
            got = max((v[1] for k, g in block.hits(ids, np.array([len(ids)])) if (v := block.verify(ids, 0, len(ids), k, g))), default=0)
            want = overlaps(doc, item, 13, 0.8)
            assert got == want, (n, changed)


def test_periodic_items():
    """One token said again and again, in an item and in a document: as many diagonals as places, found at once."""
    block = decontaminate.Block([(1, [b"a"] * 300)], 13, 0.8)
    found = block.hits(np.ones(50_000, np.int64), np.array([50_000]))
    assert len(found) == len(set(found)) == 50_000 + 300 - 1 - 2 * (min(map(len, decontaminate.MASKS)) - 1)


def test_blocks_and_odd_rows(spark, monkeypatch):
    """Several blocks of the benchmark give what one gives; null items and ids, ties, repeats and clashing columns."""
    items = [(None, "one two three four five six"), (2, None), (3, "seven eight nine ten"), (3, "seven eight nine ten"), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x seven eight nine ten x", "a"), (1, "x seven eight nine ten x", "a"), (None, "one two three four five six", "b"), (2, None, "c"), (3, "", "d"), (4, "seven " * 3000, "e")], "doc_id long, text string, item_id string")
    told = lambda: sorted((r.doc_id or 0, r.item_id, sorted(m.item_id for m in r["__matches"])) for r in decontaminate.decontaminated(docs, bench).collect())
    once = told()
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 3)
    assert once == told() == [(0, "b", [-1]), (1, "a", [3, 3]), (1, "a", [3, 3]), (2, "c", []), (3, "d", []), (4, "e", [])]


def test_base_columns(spark):
    """Symbols and repeated lines, counted by hand."""
    texts = ["a #1 $x\n\na #1 $x\n \nb|b <c>", None, "", "é & é\r\né & é\n\t\n", "x\nx\nx"]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, good boolean")
    for r in quality_rules.judged(docs, none).collect():
        t = texts[r.doc_id] or ""
        lines = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines))) and not r.kept
    assert quality_rules.judged(docs.limit(0), none).count() == 0


def test_risk_of_the_whole_rule():
    """Of many labelled samples, no more than a share delta gives a rule that rejects more than `risk` of the good."""
    risk, delta, n, failed, used = 0.02, 0.1, 3000, 0, 0
    rng = np.random.default_rng(3)
    metrics = list(quality_rules.METRICS)
    for _ in range(150):
        good = rng.beta(0.25, 9.0, (n, len(metrics)))  # each metric alone would pass near the bound
        bad = rng.beta(4, 4, (n // 4, len(metrics)))
        row = {"good": n}
        for i, m in enumerate(metrics):
            for j, t in enumerate(quality_rules.GRID):
                row[f"g_{m}_{j}"], row[f"b_{m}_{j}"] = int((good[:, i] > t).sum()), int((bad[:, i] > t).sum())
        places = quality_rules.propose(row, risk)
        cuts = [[quality_rules.loosened(places[m], s) for m in metrics] for s in range(quality_rules.LOOSEST + 1)]
        rule = lambda x, c: np.any([x[:, i] > t for i, t in enumerate(c) if t is not None], axis=0)
        other = rng.beta(0.25, 9.0, (n, len(metrics)))
        steps = quality_rules.accepted([int(rule(other, c).sum()) for c in cuts], n, risk, delta)
        if steps is not None:
            used += 1
            fresh = rng.beta(0.25, 9.0, (40_000, len(metrics)))
            failed += rule(fresh, cuts[steps]).mean() > risk
    assert used > 50 and failed <= 0.16 * 150


def test_accepted_sequence():
    """The sequence stops at the first failure; the exact bound decides."""
    ok = quality_rules.allowed
    assert ok(0, 1000, 0.005, 0.01) and ok(0, 919, 0.005, 0.01) and not ok(0, 918, 0.005, 0.01) and not ok(1, 1000, 0.005, 0.01) and not ok(0, 0, 0.5, 0.5)
    assert quality_rules.accepted([0, 9, 0, 0], 1000, 0.005, 0.01) == 2 and quality_rules.accepted([0, 0, 0, 0], 1000, 0.005, 0.01) == 0
    assert quality_rules.accepted([0, 0, 0, 9], 1000, 0.005, 0.01) is None


def test_classifier_on_planted_texts(spark):
    """Held-out texts are told apart, repeated and odd rows are kept, and the estimated accuracies are those planted."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(800)]
    fine = lambda: " ".join(rng.choice(words) for _ in range(80))
    rows, labels, truth = [], [], {}
    for i in range(1500):
        bad = i % 5 == 0
        rows.append((i, fine() if not bad else " ".join(rng.choice(words).upper() + "!!" for _ in range(80)), "x"))
        truth[i] = not bad
        if i % 3 == 0:
            wrong = rng.random() < 0.1
            labels.append((i, int(bad == wrong), 0))
    rows += [(None, fine(), "x"), (2000, None, "x"), (2001, "", "x"), (2002, fine() * 60, "x"), (7, rows[7][1], "x")]
    docs, said = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs, said).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and r.doc_id % 3]
    assert sum(r.keep == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    told = {r.labeller: r.accuracy for r in quality_model.accuracies(docs, said).collect()}
    assert set(told) == set(quality_model.LABELLERS) and 0.93 < told["label_quality"] < 0.999 and told["shouting"] > 0.9
    empty = spark.createDataFrame([], said.schema)
    assert quality_model.classify(docs.limit(0), said).count() == 0 and quality_model.classify(docs, empty).count() == len(rows)
