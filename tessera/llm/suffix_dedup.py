"""Exact repeated-substring removal by merging shard Burrows-Wheeler transforms.

A byte goes if it lies in a `width`-byte string that also starts in a document with a smaller id. All
strings are judged on the input.

0. Documents are packed into compressed batches, written once and never shuffled: what is found out about a batch is
   laid beside it (beside.py). Whole copies (equal digests) collapse: only the copy with the smallest id goes on; the
   others lose every byte.
1. Every window of `width` bytes holds a rarest-hash k-mer (its minimizer), the same in every copy of the
   window. Each batch tells every hash bucket, once, the minimizers it holds, and learns which of them another
   document holds. Windows whose minimizer is alone cannot repeat, so they need no index. This loses nothing and is
   all that is decided by hash.
2. Neighbouring windows that share a minimizer are one string of the index, keyed by the minimizer. Only these
   strings leave their batch. They are combined in each task before they are shuffled, so a passage that a third of
   all documents share is a few rows a task.
3. In each key range the distinct strings form shards; the shards' transforms are merged by interleave
   refinement up to `width` passes. The common prefixes that the passes give bound the repeated intervals,
   and the smallest document id of an interval is that of all its windows.
4. The strings' occurrences meet these ids in an equality join; what goes is laid beside the batches, united for each
   document and cut out.

Null texts are empty. Rows with equal doc_id remove nothing from one another; a null doc_id neither removes
nor loses bytes. Empty tables give no rows. Other columns are carried only by `drop_repeats`.
"""

from __future__ import annotations

import hashlib
import shutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.beside import PART_BITS, beside, lay
from tessera.llm.bwt import repeated
from tessera.llm.common import bounded, chunks, discard, leave, materialize, release, utf8

WIDTH, KMER = 50, 24
#: Text bytes of a batch and of a bucket's share, bytes of strings that a task combines, and suffixes that are merged at once.
BATCH_BYTES, BUCKET_BYTES, INDEX_BYTES, MERGE_SUFFIXES = 2 << 20, 12 << 20, 24 << 20, 1 << 17
#: A minimizer's runs are told window by window if MANY documents of a batch hold it in more than HOT batches, or if more
#: than WIDE batches do: its strings may then be too many for one task.
MANY, HOT, WIDE = 16, 32, 20_000
#: Window starts handled at once in a very long document.
SLICE = 1 << 17
PLACE_BITS = 28


def kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of every k bytes."""
    with np.errstate(over="ignore"):
        power, held, size, total, done = np.uint64(0x9E3779B97F4A7C15), data.astype(np.uint64) + np.uint64(1), 1, None, 0
        while True:
            if k & size:
                if total is None:
                    total, done = held, size
                else:
                    n = len(data) - done - size + 1
                    total, done = held[: max(0, n)] * mult + total[size : size + max(0, n)], done + size
                mult = power if done == size else mult * power
            if 2 * size > k:
                break
            held = held[:-size] * power + held[size:]
            size, power = 2 * size, power * power
        total = total[: max(0, len(data) - k + 1)]
        total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return total ^ (total >> np.uint64(29))


def minimizers(data: np.ndarray, ends: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the window starts that lie in one document (whose ends are given), runs with one minimizer:
    first start, number of starts, the minimizer's hash."""
    hashes = kmer_hashes(data, k)
    n, w = len(data) - width + 1, width - k + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, size = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), 1
    while 2 * size <= w:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[:n], least[w - size : w - size + n])
    valid = np.ones(n, bool)
    for e in ends[ends < len(data)].tolist():
        valid[max(0, e - width + 1) : e] = False
    place = (least & low).astype(np.int64)
    heads = valid & np.concatenate(([True], (place[1:] != place[:-1]) | ~valid[:-1]))
    tails = valid & np.concatenate(((place[1:] != place[:-1]) | ~valid[1:], [True]))
    first = np.flatnonzero(heads)
    return first, np.flatnonzero(tails) - first + 1, hashes[place[first]]


def runs_of(texts: list[bytes], width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all texts: text number, first start in it, number of starts, minimizer hash."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends, data = np.cumsum(lengths), np.frombuffer(b"".join(texts), np.uint8)
    out = []
    for a in range(0, max(1, len(data)), SLICE):
        part = data[a : a + SLICE + width - 1]
        first, n, h = minimizers(part, ends[(ends > a) & (ends < a + len(part))] - a, width, k)
        out.append((first + a, n, h))
    first, n, h = (np.concatenate(x) for x in zip(*out))
    owner = np.searchsorted(ends, first, side="right")
    return owner, first - (ends - lengths)[owner], n, h


def per_doc_unique(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, which of them more than one document holds, and which of them MANY or more do."""
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.empty(0, bool)
    heads = np.flatnonzero(new)
    if not len(heads):
        return h, new, new
    several = np.maximum.reduceat(owner, heads) != np.minimum.reduceat(owner, heads)
    changes = new | np.concatenate(([True], owner[1:] != owner[:-1]))
    return h[heads], several, np.add.reduceat(changes.astype(np.int64), heads) >= MANY


def buckets_of(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which buckets (the top `bits` bits) ascending hashes lie in, and where each begins and ends. Takes only the
    buckets that are there: a batch holds few of the many that a large corpus has."""
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(h) else np.empty(0, np.int64)
    return bucket[begin], begin, np.append(begin[1:], len(h))


def pack_batches(docs: DataFrame, doc_id: str, text: str, rest: tuple[str, ...] = ()) -> DataFrame:
    """Rows of documents, compressed: batch, doc ids, lengths and texts, and the columns in `rest` as an Arrow
    stream. Written once, so that a batch is the same in every later step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        batch_id = TaskContext.get().partitionId() << PART_BITS
        for x in chunks(batches, "text", BATCH_BYTES):
            texts, ids = utf8(x.column("text")), x.column("doc_id")
            yield pa.record_batch({"batch": [batch_id], "n_bytes": [sum(map(len, texts))], "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "lengths": pa.array([list(map(len, texts))], pa.list_(pa.int64())), "digests": pa.array([[hashlib.sha256(t).digest() for t in texts]], pa.list_(pa.binary())), "data": [zstandard.compress(b"".join(texts), 3)], "rest": pa.array([streamed(x.column("rest"))], pa.binary())})
            batch_id += 1

    others = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]) if rest else F.lit(None).cast("struct<none:int>")
    return materialize(bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), others.alias("rest")).mapInArrow(run, "batch long, n_bytes long, ids array<long>, lengths array<long>, digests array<binary>, data binary, rest binary"), "batches")


def streamed(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([column], names=["rest"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unstreamed(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column(0).combine_chunks()


def unpack(row: dict) -> tuple[list, list[bytes]]:
    import zstandard

    data, ends = zstandard.decompress(row["data"]), np.cumsum(row["lengths"]).tolist()
    return row["ids"], [data[b - n : b] for b, n in zip(ends, row["lengths"])]


def lay_copies(packed: DataFrame, width: int) -> str:
    """Lays beside each batch (column i) the numbers of the rows that are whole copies of a text with a smaller id.

    A digest that a third of all rows hold is one row a task in the aggregate; the join back to the rows meets the
    written aggregate, so the adaptive skew join can split it."""
    each = packed.select("batch", F.posexplode(F.arrays_zip("ids", "lengths", "digests")).alias("i", "x")).select("batch", "i", F.col("x.ids").alias("doc_id"), F.col("x.digests").alias("digest"), F.col("x.lengths").alias("n")).where(F.col("n") >= width)
    first = materialize(each.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")).where("times > 1").select("digest", "least"), "digests")
    out = lay(each.join(first, "digest").where("doc_id > least").select("batch", "i"), "copies")
    discard(first)
    return out


def texts_of(row: dict, copies: str) -> tuple[list, list[bytes], list[int]]:
    """Ids and texts of a batch, copies emptied, and the copies' numbers."""
    ids, texts = unpack(row)
    told = beside(copies, row["batch"])
    gone = told.column("i").to_pylist() if told is not None else []
    for i in gone:
        texts[i] = b""
    return ids, texts, gone


def lay_shared(packed: DataFrame, copies: str, bits: int, width: int, k: int) -> str:
    """Lays beside each batch (columns bucket, bits, hot) which of its distinct minimizers in the bucket two documents
    hold, and which of them (null: none) are hot (see HOT).

    A minimizer is told by its bucket and the next 32 bits of its hash: two that agree in these only make a candidate."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for row in x.to_pylist():
                ids, texts, _ = texts_of(row, copies)
                owner, _, _, h = runs_of(texts, width, k)
                h, several, many = per_doc_unique(_same_doc(ids)[owner], h)
                full, begin, end = buckets_of(h, bits)
                low = (h >> np.uint64(32 - bits)).astype("<u4")
                spans = list(zip(begin.tolist(), end.tolist()))
                yield pa.record_batch({"bucket": pa.array(full, pa.int32()), "batch": pa.array([row["batch"]] * len(full), pa.int64()), "hashes": pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in spans], pa.binary()), "many": pa.array([np.packbits(many[a:b]).tobytes() if many[a:b].any() else None for a, b in spans], pa.binary())})

    def answer(rows: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, "<u4") for x in rows.column("hashes").to_pylist()]
        sizes = [len(x) for x in hashes]
        known, many = (np.concatenate([np.zeros(n, np.uint8) if x is None else np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows.column(c).to_pylist(), sizes)]) for c in ("several", "many"))
        own = np.concatenate(hashes).astype(np.uint64) << np.uint64(32) | np.arange(len(known), dtype=np.uint64)
        own.sort()
        order = (own & np.uint64(0xFFFFFFFF)).astype(np.int64)
        same = (own[1:] >> np.uint64(32)) == (own[:-1] >> np.uint64(32))
        # another document's, or twice in the batch; told to every batch that holds it
        heads = np.flatnonzero(np.concatenate(([True], ~same)))
        times = np.diff(np.append(heads, len(own)))
        shared, hot, cuts = np.empty(len(own), bool), np.empty(len(own), bool), np.cumsum(sizes)[:-1]
        shared[order] = np.repeat(np.maximum.reduceat(known[order], heads).astype(bool) | (times > 1), times)
        hot[order] = np.repeat((np.add.reduceat(many[order].astype(np.int64), heads) > HOT) | (times > WIDE), times)
        told = [np.packbits(x).tobytes() for x in np.split(shared, cuts)]
        often = [np.packbits(x).tobytes() if x.any() else None for x in np.split(hot, cuts)]
        return pa.table({"batch": rows.column("batch"), "bucket": rows.column("bucket"), "bits": pa.array(told, pa.binary()), "hot": pa.array(often, pa.binary())})

    told = packed.select("batch", "ids", "lengths", "data").mapInArrow(tell, "bucket int, batch long, hashes binary, several binary, many binary")
    return lay(told.groupBy("bucket").applyInArrow(answer, "batch long, bucket int, bits binary, hot binary"), "shared")


def _same_doc(ids: list) -> np.ndarray:
    """A number per row, equal for equal ids; null ids get numbers of their own."""
    seen: dict = {}
    return np.array([seen.setdefault(("", i) if d is None else d, len(seen)) for i, d in enumerate(ids)], np.int64)


RUNS = "batch long, row int, doc_id long, at int, key long, h int, string binary"


def windows_of(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Every window of the strings: the string's number, the place in it, a hash, and the bytes."""
    lengths = np.array([len(x) for x in strings])
    times, data = lengths - width + 1, b"".join(strings)
    owner = np.repeat(np.arange(len(strings)), times)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    at = (np.cumsum(lengths) - lengths)[owner] + place
    return owner, place, kmer_hashes(np.frombuffer(data, np.uint8), width)[at], [data[i : i + width] for i in at.tolist()]


def candidate_runs(packed: DataFrame, copies: str, shared: str, bits: int, width: int, k: int) -> DataFrame:
    """Runs of windows whose minimizer two documents hold: where, the minimizer (key) and the string that the
    windows cover with a short hash of it (h). Only these pieces of the texts leave their batch.

    Around a passage that a third of all documents share, its outer minimizers stand in as many different strings as
    there are documents. Runs of such a minimizer are told window by window, each keyed by a hash of its own: the
    passage's windows are combined in each task, all others spread over all tasks."""
    import xxhash

    digest = xxhash.xxh32_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for row in x.to_pylist():
                told = beside(shared, row["batch"])
                if told is None:
                    continue
                ids, texts, _ = texts_of(row, copies)
                owner, start, count, h = runs_of(texts, width, k)
                distinct = np.unique(h)
                full, begin, end = buckets_of(distinct, bits)
                flags, often = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
                for b, said, hot in zip(np.searchsorted(full, told.column("bucket").to_numpy()).tolist(), told.column("bits").to_pylist(), told.column("hot").to_pylist()):
                    flags[begin[b] : end[b]] = np.unpackbits(np.frombuffer(said, np.uint8), count=end[b] - begin[b])
                    if hot is not None:
                        often[begin[b] : end[b]] = np.unpackbits(np.frombuffer(hot, np.uint8), count=end[b] - begin[b])
                of = np.searchsorted(distinct, h)
                keep = flags[of] & ~np.array([d is None for d in ids], bool)[owner]
                owner, start, count, h, hot = owner[keep], start[keep], count[keep], h[keep], often[of[keep]]
                strings = [texts[i][a : a + n] for i, a, n in zip(owner.tolist(), start.tolist(), (count + width - 1).tolist())]
                if hot.any():
                    which, place, own, windows = windows_of([strings[i] for i in np.flatnonzero(hot).tolist()], width)
                    strings = [strings[i] for i in np.flatnonzero(~hot).tolist()] + windows
                    owner, start, h = (np.concatenate((x[~hot], y)) for x, y in ((owner, owner[hot][which]), (start, start[hot][which] + place), (h, own)))
                doc_ids = np.array([-1 if d is None else d for d in ids], np.int64)[owner]
                short = np.fromiter((digest(s) - (1 << 31) for s in strings), np.int32, len(strings))
                yield pa.record_batch({"batch": np.full(len(owner), row["batch"]), "row": owner.astype(np.int32), "doc_id": doc_ids, "at": start.astype(np.int32), "key": h.view(np.int64), "h": short, "string": pa.array(strings, pa.binary())})

    return materialize(packed.select("batch", "ids", "lengths", "data").mapInArrow(run, RUNS), "runs")


def combined(rows: pa.Table) -> pa.Table:
    """key, h, string, first, last: one row per string, with the smallest and largest id that hold it."""
    out = rows.group_by(["key", "h", "string"], use_threads=False).aggregate([("first", "min"), ("last", "max")])
    return out.rename_columns([c.removesuffix("_min").removesuffix("_max") for c in out.column_names]).select(["key", "h", "string", "first", "last"])


STRINGS = "key long, h int, string binary, first long, last long"


def index_strings(runs: DataFrame) -> DataFrame:
    """The strings of the index, combined within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > INDEX_BYTES:
                yield from combined(pa.Table.from_batches(held)).to_batches(1 << 15)
                held, size = [], 0
        if held:
            yield from combined(pa.Table.from_batches(held)).to_batches(1 << 15)

    return bounded(runs).select("key", "h", "string", F.col("doc_id").alias("first"), F.col("doc_id").alias("last")).mapInArrow(run, STRINGS)


LEAST = "key long, h int, lo int, hi int, least long"


def merged_ids(strings: DataFrame, width: int) -> DataFrame:
    """key, h, lo, hi, least: the windows lo..hi of the string have that smallest doc_id.

    Where all strings of a key are equal there is nothing to merge: the string is the repeated interval."""
    names = [x.split()[0] for x in LEAST.split(", ")]

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        items, docs, keys, hs = rows.column("string").to_pylist(), rows.column("first").to_numpy(), rows.column("key").to_numpy(), rows.column("h").to_numpy()
        lengths = [len(x) - width + 1 for x in items]
        least, owner = np.concatenate(repeated(items, docs, width)), np.repeat(np.arange(len(items)), lengths)
        place = np.arange(len(least)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        heads = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]))))
        tails, of = np.append(heads[1:], len(least)) - 1, owner[heads]
        yield pa.record_batch([keys[of], hs[of], place[heads].astype(np.int32), place[tails].astype(np.int32), least[heads]], names=names)

    def close(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """rows: all strings of some keys, ordered by key."""
        rows = combined(rows)
        rows = rows.take(np.argsort(rows.column("key").to_numpy(), kind="stable"))
        keys = rows.column("key").to_numpy()
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(heads, len(keys)))
        alone = np.repeat(sizes == 1, sizes)
        plain = rows.filter(pa.array(alone & (rows.column("first").to_numpy() < rows.column("last").to_numpy())))
        if len(plain):
            ends = pa.array(pc.binary_length(plain.column("string")).to_numpy() - width, pa.int32())
            yield from pa.table([plain.column("key"), plain.column("h"), pa.array(np.zeros(len(plain), np.int32)), ends, plain.column("first")], names=names).to_batches()
        several = rows.filter(pa.array(~alone))
        if len(several):
            keys = several.column("key").to_numpy()
            upto = np.cumsum(pc.binary_length(several.column("string")).to_numpy().astype(np.int64) + 1)
            ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
            a = 0
            while a < len(keys):  # whole keys, about MERGE_SUFFIXES suffixes at once
                b = int(ends[min(len(ends) - 1, np.searchsorted(ends, np.searchsorted(upto, (upto[a - 1] if a else 0) + MERGE_SUFFIXES) + 1))])
                yield from solve(several.slice(a, b - a))
                a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size > INDEX_BYTES:
                rows = pa.Table.from_batches(held)
                keys = rows.column("key").to_numpy()
                whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if whole:
                    yield from close(rows.slice(0, whole))
                    held, size = rows.slice(whole).combine_chunks().to_batches(), rows.slice(whole).nbytes
                else:  # one key alone: equal strings become one
                    held = combined(rows).combine_chunks().to_batches()
                    size = 0
        if held:
            yield from close(pa.Table.from_batches(held))

    return strings.repartition("key").sortWithinPartitions("key").mapInArrow(run, LEAST)


def lay_removed(runs: DataFrame, least: DataFrame, width: int) -> str:
    """Lays beside each batch (columns row, a, b) the bytes a..b-1 of the row's text that go (they may overlap)."""
    there = runs.select("batch", "row", "doc_id", "at", "key", "h")
    gone = there.join(least, ["key", "h"]).where("doc_id > least").select("batch", "row", (F.col("at") + F.col("lo")).alias("a"), (F.col("at") + F.col("hi") + width).alias("b"))
    return lay(gone, "removed")


RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<a:int,b:int>>, kept binary"


def united(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of each row."""
    order = np.lexsort((a, row))
    row, a, b = row[order].astype(np.int64), a[order].astype(np.int64), b[order].astype(np.int64)
    upto = np.maximum.accumulate(row << 32 | b)  # a row's ends lie above those of the rows before
    new = np.concatenate(([True], (row[1:] << 32 | a[1:]) > upto[:-1]))
    heads = np.flatnonzero(new)
    return row[heads], a[heads], (upto & 0xFFFFFFFF)[np.append(heads[1:], len(row)) - 1]


def cut(packed: DataFrame, copies: str, removed: str, rest_type: str, whole_characters: bool = False) -> DataFrame:
    """RESULT and rest of every row of the batches. whole_characters: parts of characters that a cut leaves go too
    (n_removed does not count them)."""
    kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for row in x.to_pylist():
                ids, texts = unpack(row)
                whole, gone = beside(copies, row["batch"]), beside(removed, row["batch"])
                spans: list[list] = [[] for _ in ids]
                if gone is not None and len(gone):
                    for i, a, b in zip(*(c.tolist() for c in united(*(gone.column(c).to_numpy() for c in ("row", "a", "b"))))):
                        spans[i].append((a, b))
                for i in whole.column("i").to_pylist() if whole is not None else []:
                    spans[i] = [(0, len(texts[i]))]
                kept = [cut_out(t, s) if s else t for t, s in zip(texts, spans)]
                out = [ids, row["lengths"], [len(t) - len(k) for t, k in zip(texts, kept)], [[{"a": a, "b": b} for a, b in s] for s in spans], kept]
                if whole_characters:
                    out[-1] = [k.decode("utf-8", "ignore").encode() if s else k for k, s in zip(kept, spans)]
                yield pa.record_batch([*(pa.array(c, kind) for c, kind in zip(out, kinds)), unstreamed(row["rest"])], names=names)

    return packed.select("batch", "ids", "lengths", "data", "rest").mapInArrow(run, f"{RESULT}, rest {rest_type}")


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)]))


def repeats(docs: DataFrame, width: int = WIDTH, k: int = KMER, doc_id: str = "doc_id", text: str = "text", rest: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """One row per document: its bytes, how many go, the spans that go, the bytes that are left, and the columns of
    `rest`. The texts are written once, compressed; only candidate strings are shuffled."""
    packed = pack_batches(docs, doc_id, text, rest)
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    least_buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(31, max(2, (-(-total // BUCKET_BYTES) - 1).bit_length(), (least_buckets - 1).bit_length()))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rest_type = "struct<" + (",".join(f"c{i}:{kinds[c]}" for i, c in enumerate(rest)) or "none:int") + ">"
    copies = lay_copies(packed, width)
    shared = lay_shared(packed, copies, bits, width, k)
    release(docs.sparkSession)
    runs = candidate_runs(packed, copies, shared, bits, width, k)
    shutil.rmtree(shared)
    least = materialize(merged_ids(index_strings(runs), width), "least")
    release(docs.sparkSession)
    removed = lay_removed(runs, least, width)
    discard(runs)
    discard(least)
    release(docs.sparkSession)
    leave(packed)
    return cut(packed, copies, removed, rest_type, whole_characters)


def drop_repeats(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the repeated bytes cut out of the text (and with them the parts of characters that a cut leaves), all
    other columns kept, n_chars counted anew if there is one. Documents of which nothing is left go."""
    others = tuple(c for c in docs.columns if c != text)
    cut_ = repeats(docs, width, doc_id=doc_id, text=text, rest=others, whole_characters=True).where("n_removed = 0 or length(kept) > 0")
    named = cut_.select(*[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(others)], F.col("kept").cast("string").alias(text))
    named = named.withColumn("n_chars", F.length(text).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in others else named
    return named.select(*docs.columns)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: 50 bytes, all documents."""
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
