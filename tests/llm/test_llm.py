import collections
import hashlib
import random
import re
import tempfile
import zlib

import numpy as np
import public_tokenizers

from tessera.llm import bwt, chat_format, decontaminate, elias_fano, encoding, language_model, packing, quality_model, quality_rules, simhash, suffix_dedup, token_files, url_filter
from tessera.llm.common import fresh_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text2 string"
PASSAGE = "the quick brown fox jumps over the lazy dog while ten small mice watch it from under an old oak table and say nothing at all"
LONG = " ".join(f"w{i % 700}x{i}" for i in range(9000))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in texts], DOCS)


def mixed():
    rng = random.Random(3)
    said = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    out = [(i, said(rng.randint(0, 90))) for i in range(40)]
    out += [(40, None), (41, ""), (42, " \t\n"), (43, LONG), (44, LONG + " end"), (45, out[3][1]), (45, out[3][1]), (46, f"{said(20)} {PASSAGE} {said(20)}"), (47, f"{said(9)} {PASSAGE}")]
    return out


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    for texts in (mixed() + [(None, "no id"), (-1, "x"), (None, None)], []):
        got = token_files.read_tokens(spark, token_files.write_tokens(table(spark, texts), path, 2, fresh_path(spark, "t"))).orderBy("start").collect()
        at = 0
        for row, (i, t) in zip(got, sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), strict=True):
            ids = np.array(encoding.encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            assert tuple(row) == (i, at, len(ids), zlib.crc32(ids))
            at += len(ids)


def test_encoder():
    """Joined, single and forgotten words all give the tokenizer's own ids."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(2)
    odd = ["don't it's 'tis !'s ''", "a<|endoftext|>b <|x", "\u0130stanbul \u00c9 \u00bd\u00bd x\u00b2y", "\u4e2d\u6587 \u0301", "\x00 \x1c a\x1fb \x85 ", "", " \t\n"]
    odd += ["".join(rng.choice("abz\u00e9'.,!$1 _<|>\u00bdST\u0130  \n") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    own = encoding.Encoder(path, 500)
    assert own.joined.usable
    for a in range(0, len(odd), 100):
        flat, lengths = own.encode([t.encode() for t in odd[a : a + 100]], 2)
        want = [own.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in odd[a : a + 100]]
        assert lengths.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    limits = packing.Limits(256, 4, 200)
    texts = [(i, t) for i, t in mixed() if i != 45]
    rows = packing.pack(table(spark, texts).coalesce(2), path, 1, limits).collect()
    sequences, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        docs[r.doc_id].append(r)
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0] + [r.length for r in s])[:-1].tolist()
        total = sum(r.length for r in s)
        assert total <= 256 and len(s) <= 4 and total <= 200 or total & (total - 1) == 0 and total <= 256
    for i, t in texts:
        ids = encoding.encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(docs[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == np.array(ids, "<u4").tobytes() and all(r.doc_tokens == len(ids) for r in parts)
    assert packing.pack(table(spark, []), path, 1).count() == 0


def test_simhash(spark):
    texts = mixed()
    texts += [(100 + k, LONG.replace("w5x", f"v{k}x")) for k in range(30)]
    rows = simhash.near_groups(table(spark, texts)).collect()
    ids, fps = np.array([r.doc_id for r in rows]), np.array([r.fp for r in rows]).view(np.uint64)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            a, b = find(i), find(int(j))
            if ids[a] > ids[b]:
                a, b = b, a
            up[b] = a
    assert len(rows) == len(texts) and all(r.component_id == ids[find(i)] for i, r in enumerate(rows))
    assert simhash.near_groups(table(spark, [])).count() == 0


def test_repeated_intervals():
    rng = random.Random(1)
    for _ in range(30):
        items = list({bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(5, 12))) for _ in range(9)})
        docs = np.array([rng.randint(0, 50) for _ in items])
        for x, least in zip(items, bwt.repeated(items, docs, 5, 3)):
            assert least.tolist() == [min(int(d) for y, d in zip(items, docs) if x[p : p + 5] in y) for p in range(len(x) - 4)]


def test_suffix_dedup(spark):
    texts = [(i, t) for i, t in mixed()] + [(50, "x" * 300), (51, "x" * 60 + "é" * 40), (None, PASSAGE)]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.repeats(table(spark, texts)).collect())
    first: dict = {}
    for i, t in texts:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    want = collections.Counter()
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[(i, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    assert got == want
    cut = suffix_dedup.drop_repeats(table(spark, texts))
    assert cut.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and cut.where("text2 <> 'clash'").count() == 0
    assert suffix_dedup.repeats(table(spark, [])).count() == 0


def test_language_model(spark):
    docs = table(spark, mixed())
    rows = language_model.score(docs, language_model.train(docs, fresh_path(spark, "lm"))).collect()
    assert len(rows) == len(mixed()) and all(np.isfinite(r.score) and r.score <= 0 for r in rows)
    counts = collections.Counter(w for i, t in mixed() if not language_model.held_out(i) for w in (t or "").encode().lower().split() + [b" "])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        assert r.train_tokens == n and any(r.n_tokens == len((t or "").encode().lower().split()) + 1 for i, t in mixed() if i == r.doc_id)
    texts = dict(mixed())
    for r in rows:
        words = (texts[r.doc_id] or "").encode().lower().split() + [b" "]
        assert abs(r.base_score - sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)) < 1e-6 * len(words)
    empty = table(spark, [])
    assert language_model.score(empty, language_model.train(empty, fresh_path(spark, "lm"))).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (1000, 10**12), (1000, 1500), (3000, 100), (0, 0), (200, 2**60)):
        values, folder = np.sort(rng.integers(0, top + 1, n)).astype(np.uint64), tempfile.mkdtemp()
        elias_fano.save(folder, "x", elias_fano.encode(values))
        s = elias_fano.Sequence(folder, "x")
        keys = np.concatenate((values, rng.integers(0, top + 2, 500).astype(np.uint64)))
        assert (s.at(np.arange(n)) == values).all() and (s.successor(keys) == np.searchsorted(values, keys)).all()


def test_decontaminate(spark):
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (3, "zebra quilt"), (4, "!!")], "item_id long, text string")
    words = PASSAGE.split()
    words[4], words[11] = "cat", "rats"
    texts = [*mixed(), (60, " ".join(words)), (61, "a zebra quilt here"), (62, "only ten small mice watch it from here on")]
    got = {r.doc_id: sorted(m.item_id for m in r["__matches"]) for r in decontaminate.decontaminated(table(spark, texts), bench).collect()}
    assert {i for i, m in got.items() if m} == {46, 47, 60, 61} and got[60] == [1] and got[61] == [3]
    assert decontaminate.decontaminated(table(spark, []), bench).count() == 0


def test_quality_rules(spark):
    rng = random.Random(5)
    texts = mixed() + [(200 + k, " ".join(rng.choice("abc") for _ in range(60 + k)) + "\nx\nx\n\n") for k in range(20)] + [(300, "a b c d " * 80)]
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judged(table(spark, texts), spark.createDataFrame([(1, True), (2, None)], "doc_id long, good boolean")).collect()}
    for i, t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        windows = list(zip(w, w[1:], w[2:]))
        seen = collections.Counter(windows)
        covered = {p + q for p, x in enumerate(windows) if seen[x] > 1 for q in range(3)}
        r = got[i, len(w)]
        assert r.n_repeat_words == len(covered) and r.word_chars == sum(map(len, w)) and r.kept == (not r.base_failed)
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert quality_rules.allowed(0, 1000, 0.01, 0.001) and not quality_rules.allowed(3, 1000, 0.005, 0.001)


def test_quality_model():
    counts = collections.Counter()
    for text, n in ((PASSAGE, 800), ("STOP IT NOW!! " * 20, 60), ("you idiot, you moron go away " + PASSAGE, 50)):
        counts[9 * quality_model.votes(text.encode())[0]] += n
    clean = quality_model.WeakLabels(counts).clean()
    said = [clean[9 * quality_model.votes(t.encode())[0]] for t in (PASSAGE, "STOP IT NOW!! " * 20, "you idiot, you moron go away " + PASSAGE)]
    assert said[0] > 0.5 > max(said[1:])
    assert quality_model.fit([]).sum() == 0


def test_chat_format(spark):
    ok = "</s>[INST] ok \\ [/INST]<s>"
    rows = spark.createDataFrame([(1, ok, ok, None, None), (2, None, None, [("human", ok), ("gpt", None)], None), (3, None, None, None, "x")], "id long, prompt string, completion string, conversations array<struct<`from`:string,value:string>>, other string")
    got = {r.id: r for r in chat_format.parse(chat_format.format_chat(rows)).collect()}
    assert [tuple(t) for t in got[1].read_turns] == [("user", ok), ("assistant", ok)] and got[1].loss_text == ok
    assert [tuple(t) for t in got[2].read_turns] == [("user", ok), ("assistant", "")] and got[2].layout == "conversations"
    assert got[3].read_turns == [] and got[3].layout is None
    for c in chat_format.CONTROL:
        assert c not in chat_format.CONTROL[0][0] + "\\" and got[1].formatted.count("</s>") == 2


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.ORG/es/x?q"), (2, "https://www.x.net/a/?utm_source=f#t"), (3, None), (4, "nothing"), (5, "http://b.com/fr/1"), (6, "http://x.net/b")], "page_id long, url string")
    listed = spark.createDataFrame([("x.net/a",), ("x.net/a",), ("",)], "url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert got == {1: ("example.org/es/", "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: ("com/fr/", "allow"), 6: (None, "allow")}
    assert url_filter.judge(pages, listed.limit(0)).where("listed").count() == 0
