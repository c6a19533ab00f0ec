"""Near copies by exact Jaccard similarity of word shingles; SimHash links and MinHash bands only propose the pairs.

Two texts are linked if the sets of their shingles have a Jaccard similarity of at least `least`. Proposals come from
the deletion-variant index of simhash.py (fingerprints over the same shingles, `distance` differing bits) and, as a
64-bit fingerprint cannot reach a similarity of 0.8 (such pairs differ in ten bits and more), from MinHash: ROWS
min-hashes make a band and BANDS bands a signature: a pair of similarity 0.8 shares a band with probability
1 - (1 - 0.8^8)^40 = 99.9 %, one of 0.85 practically always. No pair below `least` is linked.

Texts with the same words are one node from the start. Nodes that share a band are tied to the first of the
band (never all pairs); each connected set of candidates goes to one task, which walks it from text to text
along shared bands and verifies each step by the shingles themselves, all candidates of a step at once. A walk
tells a spanning forest of the verified links, which is what groups need. A task holds the shingle hashes of one
candidate set.

Fewer words than a shingle are one shingle. Wordless and null texts are copies of one another. Repeated rows
are rows of one group. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.beside import ROW_BITS, lay, places
from tessera.llm.common import bounded, chunks, discard, materialize, release, utf8
from tessera.llm.graph import components
from tessera.llm.simhash import links, vote

BANDS, ROWS = 40, 8
#: Shingles whose hashes are permuted at once.
BLOCK = 1024


def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return tuple(rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1) for _ in range(2))


FLIP, FACTOR = _constants()


def shingles(text: bytes, k: int) -> np.ndarray:
    """The hashes of the text's shingles, in order."""
    import xxhash

    digest, words = xxhash.xxh64_intdigest, text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(line[a:b], 42) for a, b in pairs), np.uint64, len(words) - k + 1)


def bands(hashes: np.ndarray) -> list[int]:
    """A signed 64-bit key per band."""
    import xxhash

    least, low = np.full(BANDS * ROWS, ~np.uint32(0)), hashes.astype(np.uint32)
    for a in range(0, len(low), BLOCK):
        mixed = low[a : a + BLOCK] ^ FLIP
        mixed *= FACTOR
        least = np.minimum(least, mixed.min(1))
    raw, step = least.tobytes(), 4 * ROWS
    keys = np.array([xxhash.xxh64_intdigest(raw[i * step : (i + 1) * step], i) for i in range(BANDS)], np.uint64)
    return keys.view(np.int64).tolist()


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, digest (of the lower-cased words), fp (SimHash fingerprint), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in chunks(batches):
            texts = utf8(batch.column("text"))
            digests = [xxhash.xxh128_digest(b" ".join(t.lower().split())) for t in texts]
            hashes = [shingles(t, shingle) for t in texts]
            fps = np.array([vote(h) if len(h) else 0 for h in hashes], np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "digest": pa.array(digests, pa.binary()), "fp": fps, "bands": pa.array([bands(np.unique(h)) for h in hashes], pa.list_(pa.int64()))})

    return bounded(docs).mapInArrow(run, "doc_id long, digest binary, fp long, bands array<long>")


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges a, b that tie the nodes of each band to the band's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for batch in batches:
            keys, reps = batch.column("key").to_numpy(), batch.column("rep").to_numpy()
            if not len(keys):
                continue
            new = np.concatenate(([key is None or keys[0] != key], keys[1:] != keys[:-1]))
            at = np.maximum.accumulate(np.where(new, np.arange(len(keys)), -1))
            heads = np.where(at < 0, reps[0] if head is None else head, reps[at])
            key, head = keys[-1], heads[-1]
            other = heads != reps
            yield pa.record_batch({"a": reps[other], "b": heads[other]})

    keyed = nodes.select(F.explode("bands").alias("key"), "rep")
    return keyed.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(run, "a long, b long")


def walked(sets: list[np.ndarray], keys: list[list[int]], least: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the verified links between nodes that share a key in the same place of their lists.
    sets: distinct shingles of each node."""
    sizes = np.array([len(x) for x in sets])
    starts, shared = np.cumsum(sizes) - sizes, np.array(keys, np.int64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), bool)
    todo = np.arange(len(sets))
    while len(todo):
        frontier, todo = [int(todo[0])], todo[1:]
        while frontier and len(todo):
            at = frontier.pop()
            n, m = sizes[at], sizes[todo]
            near = np.flatnonzero((np.minimum(m, n) >= least * np.maximum(m, n)) & (shared[todo] == shared[at]).any(1))
            if not len(near):
                continue
            own, m = todo[near], m[near]
            mark[flat[starts[at] : starts[at] + n]] = True
            held = mark[flat[np.repeat(starts[own] - np.cumsum(m) + m, m) + np.arange(m.sum())]]
            both = np.diff(np.concatenate(([0], np.cumsum(held)))[np.concatenate(([0], np.cumsum(m)))])
            mark[flat[starts[at] : starts[at] + n]] = False
            linked = np.where(n + m == both, True, both / np.maximum(1, n + m - both) >= least)
            yield from ((at, j) for j in own[linked].tolist())
            frontier += own[linked].tolist()
            todo = np.delete(todo, near[linked])


def verified(members: DataFrame, shingle: int, least: float) -> DataFrame:
    """members: set, rep, text, bands. Edges a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, sets, keys = None, [], [], []

        def out():
            found = [(reps[i], reps[j]) for i, j in walked(sets, keys, least)] if reps else []
            if found:
                a, b = zip(*found)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in chunks(batches):
            for at, rep, text, own in zip(batch.column("set").to_pylist(), batch.column("rep").to_pylist(), utf8(batch.column("text")), batch.column("bands").to_pylist()):
                if at != now:
                    yield from out()
                    now, reps, sets, keys = at, [], [], []
                reps.append(rep)
                sets.append(np.unique(shingles(text, shingle)))
                keys.append(own)
        yield from out()

    return bounded(members).repartition("set").sortWithinPartitions("set").mapInArrow(run, "a long, b long")


def with_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members (rep, set, bands) with their texts. Only the members' texts leave their place."""
    folder = lay(members.select("rep", "set", "bands"), "members", "rep", ROW_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, found in places(folder, batch.column("doc_id").to_numpy(), "rep"):
                if len(own):
                    found = found.combine_chunks()
                    yield pa.record_batch([*(found.column(c).combine_chunks() for c in ("set", "rep", "bands")), batch.column("text").take(own)], names=["set", "rep", "bands", "text"])

    return bounded(docs).mapInArrow(run, "set long, rep long, bands array<long>, text string")


def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, distance: int = 4) -> DataFrame:
    """docs: doc_id (as monotonically_increasing_id gives it, written), text. doc_id, group (the smallest doc_id of its
    near copies)."""
    docs = docs.select("doc_id", "text")
    signed = materialize(signatures(docs, shingle), "signatures")
    nodes = materialize(signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("fp", "doc_id").alias("fp"), F.min_by("bands", "doc_id").alias("bands")), "texts")
    alike = materialize(components(links(nodes, distance)), "alike")
    edges = candidates(nodes).unionByName(alike.select(F.col("node").alias("a"), F.col("component").alias("b")))
    maybe = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("set"))
    keyed = nodes.select("rep", "bands").join(maybe, "rep").join(alike.withColumnRenamed("node", "rep"), "rep", "left")
    members = with_texts(docs, keyed.withColumn("bands", F.concat("bands", F.array(F.coalesce("component", "rep")))))
    found = components(verified(members, shingle, least)).withColumnRenamed("node", "rep")
    named = materialize(nodes.select("digest", "rep").join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("group")), "groups")
    out = materialize(signed.select("doc_id", "digest").join(named, "digest").select("doc_id", "group"), "grouped")
    for table in (signed, nodes, alike, named):
        discard(table)
    release(docs.sparkSession)
    return out
