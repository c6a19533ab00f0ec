import collections
import random

import numpy as np

from tessera.llm import language_model
from tessera.llm.common import fresh_path


def test_singleton_pairs_count(spark):
    """Scores are those of the formula over all pairs; a pair seen once scores above an unseen one."""
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice("abcdefgh") * rng.choice((1, 1, 1, 2, 3, 4)) for _ in range(40)) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = language_model.score(docs, language_model.train(docs, fresh_path(spark, "lm"))).collect()
    split = {i: t.encode().split() + [b" "] for i, t in texts.items()}
    own = [w for i, w in split.items() if not language_model.held_out(i)]
    words, pairs, times = (collections.Counter() for _ in range(3))
    for w in own:
        words.update(w)
        pairs.update(zip([None, *w], w))
        times.update([None, *w[:-1]])
    n, v = sum(words.values()), len(words)
    seen = collections.Counter(pairs.values())
    d = [0, *language_model.discounts([seen[i] for i in (1, 2, 3, 4)])]
    kept = {k: c - d[min(c, 3)] for k, c in pairs.items()}
    mass = collections.Counter()
    for (c, _), x in kept.items():
        mass[c] += x
    p = lambda c, w: kept.get((c, w), 0) / max(1, times[c]) + (1 - mass[c] / times[c] if times[c] else 1) * (words[w] + 0.1) / (n + 0.1 * (v + 1))
    assert seen[1] > 20 and abs(sum(p(b"a", w) for w in [*words, b"?"]) - 1) < 1e-9
    for r in rows:
        w = split[r.doc_id]
        want = sum(np.log10(p(c, x)) for c, x in zip([None, *w], w))
        assert abs(r.score - want) < 0.0005 * len(w)
