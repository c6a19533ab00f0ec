"""Language-model scoring with an Elias-Fano n-gram trie.

Tokens are lower-cased words and one end per text. The model is an interpolated bigram model with three
discounts estimated from the counts of counts:

    p(w | c) = max(count(c w) - D, 0) / count(c) + rest(c) * p(w),   p(w) = (count(w) + 0.1) / (N + 0.1 (V + 1))

where D depends on whether the pair was seen once, twice or more often, and rest(c) is what the discounts of all
pairs of c leave over; over the V words and one unknown word the probabilities sum to one (up to quantisation).

Levels, all memory-mapped files in the shared folder, cut into parts of bounded size:
  words     ascending 64-bit word hashes (Elias-Fano); a word's id is its place. Counts, in as few bytes as the largest
            needs, and p(w) as a 16-bit code.
  contexts  ascending context ids (Elias-Fano) and rest(c) as 16-bit codes.
  pairs     per part: its contexts and the monotone pointers to their first successors (Elias-Fano each);
            successor ids, each context's shifted by the last value before it so that the whole level
            ascends (Elias-Fano); 16-bit codes. A pair is looked up by its context's place, its pointers,
            and a successor search relative to the context's base.

Counts are combined in each task before they are shuffled; pairs are counted in buckets by their hash, so a
word that makes up a third of all tokens is split over all of them. Words that share a 64-bit hash share a
count. At most 2^31 distinct words. Null texts are empty (one end); repeated rows count as often as they
occur; a null doc_id counts as held out; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, chunks, discard, fresh_path, local_file, materialize, release, utf8
from tessera.llm.elias_fano import Sequence, encode, load, save

END = b" "  # no word holds a blank
CHUNK = 2 << 20
#: Words, pairs and rows a part or a task's table holds.
PART_WORDS, PART_PAIRS, BUCKET_PAIRS, HELD_WORDS, HELD_PAIRS = 4_000_000, 2_000_000, 2_000_000, 200_000, 2_000_000
#: A probability's code is its -log10 in these steps.
STEP = 1 / 2000


def held_out(doc: int | None) -> bool:
    return doc is None or zlib.crc32(str(doc).encode()) % 10 == 0


def code(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-np.log10(p) / STEP), 0, 65535).astype(np.uint16)


def value(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (codes * -STEP)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words; each token's word; the number of tokens of each text."""
    import xxhash

    known: dict[bytes, int] = {}
    words = [t.lower().split() for t in texts]
    for w in words:
        w.append(END)
    flat = [known.setdefault(w, len(known)) for ws in words for w in ws]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    return hashes, np.array(flat, np.int64), np.fromiter(map(len, words), np.int64, len(words))


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for batch in chunks(batches, "text", CHUNK):
        yield batch.column("doc_id").to_pylist(), utf8(batch.column("text"))


def training(ids: list, texts: list[bytes]) -> list[bytes]:
    return [t for d, t in zip(ids, texts) if not held_out(d)]


def word_counts(docs: DataFrame) -> DataFrame:
    """h (hash as signed long), c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_c, size = [], [], 0

        def out():
            if held_h:
                h, at = np.unique(np.concatenate(held_h), return_inverse=True)
                yield pa.record_batch({"h": h.view(np.int64), "c": np.bincount(at, np.concatenate(held_c)).astype(np.int64)})

        for ids, texts in texts_of(batches):
            if own := training(ids, texts):
                hashes, flat, _ = tokens(own)
                held_h.append(hashes)
                held_c.append(np.bincount(flat, minlength=len(hashes)))
                size += len(hashes)
                if size > 5 * HELD_WORDS:
                    yield from out()
                    held_h, held_c, size = [], [], 0
        yield from out()

    return docs.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _unsigned(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.uint64)


def write_words(spark: SparkSession, counts: DataFrame, folder: str) -> dict:
    """The level of words. A part holds a range of hashes; ids go on from part to part."""
    n, total = counts.agg(F.count("*"), F.sum("c")).first()
    parts = max(1, -(-n // PART_WORDS))
    bits = max(0, (parts - 1).bit_length())
    total, scale = total or 0, (total or 0) + 0.1 * (n + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            part, h, c = (b.column(x).to_numpy(zero_copy_only=False) for x in ("part", "h", "c"))
            for p in np.unique(part).tolist():
                held.setdefault(p, []).append((h[part == p], c[part == p]))
        for p, x in held.items():
            h, c = (np.concatenate(y) for y in zip(*x))
            h = _unsigned(h)
            order = np.argsort(h)
            save(folder, f"words-{p}", encode(h[order]) | {"count": c[order].astype(np.min_scalar_type(int(c.max()))), "code": code((c[order] + 0.1) / scale)})
            yield pa.record_batch({"part": pa.array([p], pa.int64()), "n": pa.array([len(h)], pa.int64())})

    keyed = counts.withColumn("part", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = dict(tuple(r) for r in keyed.repartitionByRange(1 << bits, "part").mapInArrow(run, "part long, n long").collect())
    base = np.concatenate(([0], np.cumsum([sizes.get(p, 0) for p in range(1 << bits)]))).tolist()
    return {"bits": bits, "base": base, "words": n, "tokens": total}


class Words:
    def __init__(self, folder: str, meta: dict):
        self.folder, self.meta = folder, meta
        self.parts = {p: (Sequence(folder, f"words-{p}"), *load(folder, f"words-{p}", "count", "code")) for p in range(1 << meta["bits"]) if meta["base"][p + 1] > meta["base"][p]}

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """id (-1: unknown), count and code of each hash."""
        out, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        scale = self.meta["tokens"] + 0.1 * (self.meta["words"] + 1)
        codes = np.full(len(h), code(np.array([0.1 / scale]))[0], np.uint16)
        order = np.argsort(h)
        edges = np.searchsorted(h[order], np.arange(1, 1 << self.meta["bits"], dtype=np.uint64) << np.uint64(64 - self.meta["bits"])) if self.meta["bits"] else []
        for p, own in enumerate(np.split(order, edges)):
            if p in self.parts and len(own):
                hashes, counts, c = self.parts[p]
                at = hashes.find(h[own])
                own, at = own[at >= 0], at[at >= 0]
                out[own], count[own], codes[own] = at + self.meta["base"][p], counts[at], c[at]
        return out, count, codes


@lru_cache(maxsize=1)
def open_words(folder: str, meta: str) -> Words:
    return Words(folder, json.loads(meta))


def pairs_of(ids: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and word id of each token; `start` is the context of a text's first token."""
    context = np.concatenate(([start], ids[:-1]))
    context[np.cumsum(lengths) - lengths] = start
    return context, ids


def squeeze(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unsqueeze(raw: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def mixed(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(32)).astype(np.int64)


def pair_counts(docs: DataFrame, folder: str, meta: dict) -> DataFrame:
    """One row per hash bucket: keys (context << 32 | word) with counts, squeezed, and
    how many pairs were seen once to four times."""
    buckets, told = max(4, -(-meta["tokens"] // BUCKET_PAIRS)), json.dumps(meta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            if held:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                bucket = mixed(keys) % buckets
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))  # the buckets that are there
                for b, own in zip(bucket[heads].tolist(), np.split(order, heads[1:])):
                    if len(own):
                        yield pa.record_batch({"bucket": pa.array([b], pa.int32()), "keys": pa.array([squeeze(np.diff(keys[own], prepend=np.uint64(0)))], pa.binary()), "counts": pa.array([squeeze(counts[own])], pa.binary())})

        words = open_words(folder, told)
        for ids, texts in texts_of(batches):
            if own := training(ids, texts):
                hashes, flat, lengths = tokens(own)
                c, w = pairs_of(words.look_up(hashes)[0][flat], lengths, meta["words"])
                held.append((c.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64))
                size += len(c)
                if size > HELD_PAIRS:
                    yield from out()
                    held, size = [], 0
        yield from out()

    def add(rows: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(unsqueeze(x), dtype=np.uint64) for x in rows.column("keys").to_pylist()])
        counts = np.concatenate([unsqueeze(x) for x in rows.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts, keys = np.add.reduceat(counts, heads), keys[heads]
        n = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
        return pa.table({"keys": pa.array([squeeze(np.diff(keys, prepend=np.uint64(0)))], pa.binary()), "counts": pa.array([squeeze(counts)], pa.binary()), "n": pa.array([n], pa.list_(pa.int64()))})

    told_pairs = docs.mapInArrow(run, "bucket int, keys binary, counts binary")
    return materialize(told_pairs.groupBy("bucket").applyInArrow(add, "keys binary, counts binary, n array<long>"), "pairs")


def discounts(n: list[int]) -> list[float]:
    """For pairs seen once, twice, and three times or more, from how many were seen once to four times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    return [min(float(k), max(0.0, k - (k + 1) * y * b / a if a else k * 0.5)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def write_pairs(spark: SparkSession, pairs: DataFrame, docs: DataFrame, folder: str, meta: dict) -> dict:
    """The levels of contexts and pairs."""
    n = [x or 0 for x in pairs.agg(*[F.sum(F.element_at("n", i)) for i in (1, 2, 3, 4)]).first()]
    d, told = discounts(n), json.dumps(meta)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(b.column("keys").to_pylist(), b.column("counts").to_pylist()):
                keys, counts = np.cumsum(unsqueeze(keys), dtype=np.uint64), unsqueeze(counts).astype(np.int64)
                for a in range(0, len(keys), 1 << 17):
                    k = keys[a : a + (1 << 17)]
                    yield pa.record_batch({"c": (k >> np.uint64(32)).astype(np.int64), "w": (k & np.uint64(0xFFFFFFFF)).astype(np.int64), "n": counts[a : a + (1 << 17)]})

    def kept(counts: np.ndarray) -> np.ndarray:
        return counts - np.array([0.0, d[0], d[1], d[2]])[np.minimum(counts, 3)]

    def context_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, got = TaskContext.get().partitionId(), [[b.column(x).to_numpy(zero_copy_only=False) for x in ("c", "kept", "times")] for b in batches]
        if got:
            c, mass, times = (np.concatenate(x) for x in zip(*got))
            save(folder, f"contexts-{part}", encode(c) | {"code": code(np.maximum(1 - mass / times, 1e-9))})
            yield pa.record_batch({"part": [part], "first": [int(c[0])]})

    def pair_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, got = TaskContext.get().partitionId(), []
        for b in batches:  # 14 bytes a pair are held
            c, w, mass, times = (b.column(x).to_numpy(zero_copy_only=False) for x in ("c", "w", "kept", "times"))
            got.append((c.copy(), w.astype(np.uint32), code(mass / times)))
        if not got:
            return
        c, w, codes = (np.concatenate(x) for x in zip(*got))
        got.clear()
        heads = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        tails = np.append(heads[1:], len(c)) - 1
        base = np.concatenate(([0], np.cumsum(w[tails].astype(np.int64) + 1)[:-1]))  # the last value of the context before
        level = np.repeat(base + 1, np.diff(np.append(heads, len(c))))
        level += w
        save(folder, f"pairs-{part}-owners", encode(c[heads]))
        save(folder, f"pairs-{part}-pointers", encode(np.append(heads, len(c))))
        save(folder, f"pairs-{part}", encode(level) | {"code": codes})
        yield pa.record_batch({"part": [part], "first": [int(c[0]) << 32 | int(w[0])]})

    def with_times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds how often the context was seen, from the level of words."""
        words = open_words(folder, told)
        sizes = [words.meta["base"][p] for p in range(1 << meta["bits"])]
        for b in batches:
            c, n = b.column("c").to_numpy(), b.column("n").to_numpy()
            times = np.full(len(c), meta["texts"], np.int64)
            inside = np.flatnonzero(c < meta["words"])
            part = np.searchsorted(sizes, c[inside], side="right") - 1
            for p in np.unique(part).tolist():
                own = inside[part == p]
                times[own] = words.parts[p][1][c[own] - sizes[p]]
            yield pa.record_batch({"c": c, "w": b.column("w"), "kept": kept(n), "times": times})

    meta["texts"] = docs.mapInArrow(lambda bs: (pa.record_batch({"n": [sum(not held_out(d) for d in b.column("doc_id").to_pylist())]}) for b in bs), "n long").agg(F.sum("n")).first()[0] or 0
    every = materialize(pairs.select("keys", "counts").mapInArrow(spread, "c long, w long, n long").mapInArrow(with_times, "c long, w long, kept double, times long"), "counted")
    total = every.count()
    by_context = every.groupBy("c").agg(F.sum("kept").alias("kept"), F.max("times").alias("times"))
    size = max(1, -(-total // PART_PAIRS))
    for name, df, f in (("contexts", by_context.repartitionByRange(size, "c").sortWithinPartitions("c"), context_part), ("pairs", every.repartitionByRange(size, "c", "w").sortWithinPartitions("c", "w"), pair_part)):
        meta[name] = sorted([r["first"], r["part"]] for r in df.mapInArrow(f, "part long, first long").collect())
    discard(every)
    return meta


class Model:
    def __init__(self, folder: str, meta: dict):
        self.meta, self.words = meta, Words(folder, meta)
        self.contexts = [(first, Sequence(folder, f"contexts-{p}"), *load(folder, f"contexts-{p}", "code")) for first, p in meta["contexts"]]
        self.pairs = [(first, Sequence(folder, f"pairs-{p}-owners"), Sequence(folder, f"pairs-{p}-pointers"), Sequence(folder, f"pairs-{p}"), *load(folder, f"pairs-{p}", "code")) for first, p in meta["pairs"]]

    @staticmethod
    def _split(parts: list, keys: np.ndarray) -> Iterator[tuple]:
        """keys ascend."""
        edges = np.searchsorted(keys, np.array([x[0] for x in parts[1:]], keys.dtype))
        for part, own in zip(parts, np.split(np.arange(len(keys)), edges)):
            if len(own):
                yield part, own

    def rest(self, contexts: np.ndarray) -> np.ndarray:
        """The weight of p(w) after each context; contexts ascend."""
        out = np.ones(len(contexts))
        for (_, ids, codes), own in self._split(self.contexts, contexts):
            at = ids.find(contexts[own])
            out[own[at >= 0]] = value(codes[at[at >= 0]])
        return out

    def discounted(self, keys: np.ndarray) -> np.ndarray:
        """The discounted probability of each pair, zero if it isn't in the trie; keys ascend."""
        out = np.zeros(len(keys))
        for (_, owners, pointers, level, codes), own in self._split(self.pairs, keys):
            c, w = keys[own] >> np.uint64(32), keys[own] & np.uint64(0xFFFFFFFF)
            heads = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            each = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(c))))
            at = owners.find(c[heads])
            has = np.flatnonzero(at >= 0)
            begin, end, base = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64), np.zeros(len(heads), np.uint64)
            begin[has], end[has] = pointers.at(at[has]), pointers.at(at[has] + 1)
            later = has[begin[has] > 0]
            base[later] = level.at(begin[later] - 1)
            ask = np.flatnonzero(at[each] >= 0)
            found = level.find(base[each[ask]] + w[ask] + np.uint64(1))
            ok = (found >= begin[each[ask]]) & (found < end[each[ask]])
            out[own[ask[ok]]] = value(codes[found[ok]])
        return out

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        hashes, flat, lengths = tokens(texts)
        ids, counts, codes = self.words.look_up(hashes)
        heads, n, v = np.cumsum(lengths) - lengths, self.meta["tokens"], self.meta["words"]
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))[flat]
        # an unknown word is a context without pairs
        c, w = pairs_of(np.where(ids < 0, v + 1, ids)[flat], lengths, v)
        keys, back = np.unique((c.astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64), return_inverse=True)
        contexts = (keys >> np.uint64(32)).astype(np.int64)
        new = np.concatenate(([True], contexts[1:] != contexts[:-1]))  # keys ascend, so their contexts do
        contexts, of = contexts[new], np.cumsum(new) - 1
        p = self.discounted(keys)[back] + self.rest(contexts)[of][back] * value(codes)[flat]
        return {"n_tokens": lengths, "n_known": np.add.reduceat((counts > 0).astype(np.int64)[flat], heads), "base_score": np.add.reduceat(base, heads), "score": np.add.reduceat(np.log10(p), heads)}


@lru_cache(maxsize=1)
def open_model(folder: str) -> Model:
    with open(f"{folder}/manifest.json") as f:
        return Model(folder, json.load(f))


def train(docs: DataFrame, path: str) -> str:
    """Writes the model of the training documents under `path`; returns `path`."""
    folder = local_file(path)
    os.makedirs(folder, exist_ok=True)
    spark, rows = docs.sparkSession, bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = materialize(word_counts(rows), "words")
    meta = write_words(spark, counts, folder)
    discard(counts)
    release(spark)
    if meta["words"] >= 1 << 31:
        raise ValueError("more than 2^31 distinct words")
    pairs = pair_counts(rows, folder, meta)
    release(spark)
    meta = write_pairs(spark, pairs, rows.select("doc_id"), folder, meta)
    discard(pairs)
    release(spark)
    with open(f"{folder}/.manifest", "w") as f:
        json.dump(meta, f)
    os.replace(f"{folder}/.manifest", f"{folder}/manifest.json")
    return path


def score(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    folder = local_file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = open_model(folder)
        for ids, texts in texts_of(batches):
            if texts:
                got = model.score(texts)
                yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "held_out": [held_out(d) for d in ids], "n_tokens": got["n_tokens"], "n_known": got["n_known"], "train_tokens": pa.array([model.meta["tokens"]] * len(ids), pa.int64()), "base_score": got["base_score"], "score": got["score"]})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: learns from nine tenths of documents, scores all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, fresh_path(spark, "language-model")))
