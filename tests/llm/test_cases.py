"""The cases of the docstrings: nulls, empty and long texts, ties, repeated rows, clashing names, and more parts than one."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, language_model, packing, simhash, suffix_dedup, url_filter
from tessera.llm.common import fresh_path


def said(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


def test_turns_of_one_conversation(spark, tmp_path):
    long = "é<s>\\</s>[INST]" * 20_000
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", long), (1, None, "bot", None), (None, 0, None, "x"), (None, 1, "assistant", "[/INST]"), (2, 0, "human", "kept"), (1, 1, "assistant", "again"), (1, 1, "assistant", "again")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.op1_chat_format(spark, str(tmp_path)).collect()}
    digest = lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    one = [("bot", ""), ("user", "a"), ("user", "b"), ("assistant", long), ("assistant", "again"), ("assistant", "again")]
    one = one[:3] + sorted(one[3:])
    assert len(got) == 4 and got[1].turns_sha256 == digest(one) and got[1].loss_chars == len(long) + 10 and got[1].n_turns == 6
    assert got[1].loss_sha256 == hashlib.sha256("".join(t for r, t in one if r == "assistant").encode()).hexdigest()
    assert got[None].turns_sha256 == digest([("", "x"), ("assistant", "[/INST]")]) and got[2].turns_sha256 == digest([("human", "kept")])
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in chat_format.op1_chat_format(spark, f"{tmp_path}/none").collect()] == [-1]


def test_clashing_fields(spark):
    """Fields outside the vocabulary, and vocabulary names of another type, select nothing."""
    rows = spark.createDataFrame([(1, "p", "c", 5, "x"), (2, None, None, None, None)], "id long, prompt string, completion string, messages long, text string")
    got = {r.id: r for r in chat_format.parse(chat_format.format_chat(rows)).collect()}
    assert got[1].layout == "prompt" and [tuple(t) for t in got[1].read_turns] == [("user", "p"), ("assistant", "c")] and got[2].layout is None and got[1].text == "x"
    assert chat_format.parse(chat_format.format_chat(rows.limit(0))).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_language_model_in_parts(spark, monkeypatch, parts):
    """Null ids are held out, repeated rows count twice, and cutting the levels into parts changes no score."""
    if parts > 1:
        for name, n in (("PART_WORDS", 40), ("PART_PAIRS", 300), ("BUCKET_PAIRS", 100), ("HELD_PAIRS", 500), ("HELD_WORDS", 20)):
            monkeypatch.setattr(language_model, name, n)
    rng = random.Random(8)
    rows = [(i, said(rng, 50, "abc")) for i in range(60)] + [(5, said(rng, 9, "abc")), (None, said(rng, 30, "abcd")), (77, None), (78, ""), (79, "a " * 3000)]
    rows += [rows[1], rows[1]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(4)
    got = language_model.score(docs, language_model.train(docs, fresh_path(spark, "lm"))).collect()
    split = [(i, (t or "").encode().split() + [b" "]) for i, t in rows]
    own = [w for i, w in split if not language_model.held_out(i)]
    words, pairs, times, mass = (collections.Counter() for _ in range(4))
    for w in own:
        words.update(w)
        pairs.update(zip([None, *w], w))
        times.update([None, *w[:-1]])
    n, v, seen = sum(words.values()), len(words), collections.Counter(pairs.values())
    d = [0, *language_model.discounts([seen[i] for i in (1, 2, 3, 4)])]
    kept = {k: c - d[min(c, 3)] for k, c in pairs.items()}
    for (c, _), x in kept.items():
        mass[c] += x
    base = lambda w: (words[w] + 0.1) / (n + 0.1 * (v + 1))
    p = lambda c, w: kept.get((c, w), 0) / max(1, times[c]) + (1 - mass[c] / times[c] if times[c] else 1) * base(w)
    want = collections.Counter((i, language_model.held_out(i), len(w), sum(x in words for x in w), n, round(sum(np.log10(base(x)) for x in w), 4)) for i, w in split)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    scores = collections.defaultdict(list)
    for i, w in split:
        scores[i, len(w)].append(sum(np.log10(p(c, x)) for c, x in zip([None, *w], w)))
    for r in got:
        assert min(abs(r.score - x) for x in scores[r.doc_id, r.n_tokens]) < 0.0005 * r.n_tokens


def test_packing_limits(spark):
    """Tokens, segments and loss-bearing tokens bind together; null ids, repeated rows and long texts are whole; padding is small."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    rows = [(i, said(rng, rng.randint(0, 60)), rng.choice([0, 5, 40, None])) for i in range(400)] + [(None, said(rng, 20), 3), (7, "same", 1), (7, "same", 1), (900, said(rng, 4000), 100), (901, None, 0)]
    docs = spark.createDataFrame([(i, t, k, "x") for i, t, k in rows], "doc_id long, text string, prompt_ids long, length string").coalesce(2)
    limits = packing.Limits(512, 9, 300)
    got = packing.pack(docs, path, 1, limits, loss_from="prompt_ids").collect()
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    free = {(i, t): k or 0 for i, t, k in rows}
    whole = collections.Counter()
    for s in sequences.values():
        total = sum(r.length for r in s)
        assert total <= 512 and (len(s) <= 9 or total & (total - 1) == 0) and sorted(r.offset for r in s)[0] == 0
    from tessera.llm.encoding import encoder

    known = collections.defaultdict(list)
    for (i, t), k in free.items():
        known[i].append((len(encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids) + 1, k))
    loss = lambda r: max((min(r.length, max(0, r.start + r.length - k)) for n, k in known[r.doc_id] if n == r.doc_tokens), default=0)
    over = [s for s in sequences.values() if sum(map(loss, s)) > 300]
    assert all(sum(r.length for r in s) & (sum(r.length for r in s) - 1) == 0 for s in over)
    for r in got:
        whole[r.doc_id] += r.length
    want = collections.Counter()
    for i, t, _ in rows:
        want[i] += len(encoder(path).tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert whole == want
    plain = packing.pack(docs, path, 1).select("sequence_id", "length", "sequence_length").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("sequence_length").alias("of")).agg(F.sum("n"), F.sum("of")).first()
    assert plain[0] >= 0.98 * plain[1]


def test_bloom_filter(spark):
    """No listed URL is lost, few others pass, and the shuffled filter says the same as the broadcast one."""
    listed = spark.range(3000).select(F.concat(F.lit("a.org/"), F.col("id").cast("string")).alias("url"))
    asked = spark.range(60_000).select(F.concat(F.lit("a.org/"), F.col("id").cast("string")).alias("url"), "id")
    n = url_filter.blocks_for(3000)
    told = lambda: url_filter.possible_hits(asked, url_filter.bloom(listed, n), n, "url").where("maybe").select("id")
    hits = {r.id for r in told().collect()}
    assert set(range(3000)) <= hits and len(hits) - 3000 < 0.01 * 57_000
    keep, url_filter.BROADCAST_BYTES = url_filter.BROADCAST_BYTES, 0
    try:
        assert {r.id for r in told().collect()} == hits
    finally:
        url_filter.BROADCAST_BYTES = keep
    pages = spark.createDataFrame([], "page_id long, url string, rule string")
    assert url_filter.judge(pages.drop("rule"), listed).count() == 0


def test_simhash_fingerprints(spark, monkeypatch):
    """Fingerprints bit by bit; null ids, ties, and runs longer than a block."""
    import xxhash

    monkeypatch.setattr(simhash, "BLOCK_ROWS", 7)
    rng = random.Random(4)
    rows = [(i, said(rng, rng.randint(0, 30))) for i in range(80)] + [(None, said(rng, 12)), (90, None), (91, " \t"), (92, "A b C d"), (93, "a B c D"), (93, "a b"), (94, "x " * 9000)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fp string")

    def fingerprint(t):
        w = (t or "").lower().split()
        h = [xxhash.xxh64_intdigest(" ".join(w[a : a + 4]), 42) for a in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_groups(docs).collect()
    assert collections.Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == collections.Counter((i, fingerprint(t)) for i, t in rows)


def test_strings_of_one_key(spark, monkeypatch):
    """Merges of many small pieces, and a key whose strings fill several buffers, give what one merge gives."""
    rng = random.Random(5)
    core = "thequickbrownfoxjumpsoverthelazydogagain"
    docs = spark.createDataFrame([(i, said(rng, 12) + core + "mn"[i % 2] * 14 + said(rng, 12)) for i in range(120)], "doc_id long, text string").repartition(3)
    told = lambda: {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix_dedup.repeats(docs).collect()}
    once = told()
    monkeypatch.setattr(suffix_dedup, "MERGE_SUFFIXES", 50)
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", 400)
    assert told() == once and sum(n > 0 for n, _ in once.values()) == 118
