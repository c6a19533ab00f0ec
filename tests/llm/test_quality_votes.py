from tessera.llm import quality_model


def variety(text):
    pattern = quality_model.votes(text.encode())[0]
    return pattern // 3 ** (len(quality_model.HEURISTICS) - 1 - quality_model.HEURISTICS.index("variety")) % 3


def test_variety_of_the_whole_text():
    fresh = " ".join(f"w{i}" for i in range(400))
    assert variety(fresh) == 1 and variety(f"{fresh} {fresh}") == 1
    assert variety(fresh + " over and over again" * 300) == 0
    assert variety(fresh + " over and over again" * 100 + " " + fresh) == 0
    assert variety("over and over again " * 100) == 0 and variety("") == 0


def test_labels_are_estimated():
    """A quality label that errs on a tenth of clean texts is found to do so; soft labels stay soft."""
    fine, bad = (quality_model.votes(t.encode())[0] for t in (" ".join(f"w{i}" for i in range(60)), "STOP IT NOW!! " * 20))
    counts = {9 * fine: 2000, 9 * fine + 3 * 1 + 1: 900, 9 * fine + 3 * 2 + 1: 100, 9 * bad: 200, 9 * bad + 3 * 2 + 1: 100}
    weak = quality_model.WeakLabels(counts)
    rate = weak.prior[0] * weak.table[0, -2, 2] + sum(weak.prior[c] * weak.table[c, -2, 2] for c in range(1, len(weak.prior)))
    assert 0.12 < rate < 0.25 and weak.table[2, -2, 2] > 0.9
    clean = weak.clean()
    assert clean[9 * fine + 3 * 1 + 1] > 0.9 > 0.1 > clean[9 * bad + 3 * 2 + 1]
    w = quality_model.fit([(0.5, quality_model.np.array([5], "i4"))] * 200)
    assert abs(w[5] + w[0]) < 0.1
