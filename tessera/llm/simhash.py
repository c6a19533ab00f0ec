"""SimHash near-duplicate groups by deletion-variant signatures.

A 64-bit fingerprint has a bit set where more than half of a text's shingle hashes have it. With at most
d differing bits and floor(d / 2) + 1 segments, some segment of two linked fingerprints differs by at most
one bit (d = 4: three segments instead of the usual five). Each fingerprint therefore enters, for every
segment and every bit of it, the variant with that bit deleted; linked fingerprints meet in an equality on
(segment, deleted bit, other bits) and are verified by the exact bit count.

Whole copies share a fingerprint and are one node from the start. Within a bucket no list of all pairs is
made: small runs are compared by shifted arrays, large ones by a search that removes what it has reached,
and both give a spanning forest of the exact links, which is what groups need.

Null or wordless texts have fingerprint zero and are linked as any other; fewer words than a shingle are
one shingle. Repeated rows are kept. A null doc_id is kept as a row and counts in no group's smallest id.
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, chunks, materialize, utf8
from tessera.llm.graph import components

#: Runs of a bucket up to this size are compared by shifted arrays.
SMALL_RUN = 24
#: Rows of the variant table that are handled at once.
BLOCK_ROWS = 200_000


def vote(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    ones, n = np.zeros(64, np.int64), len(hashes)
    for a in range(0, n, 255 * 64):
        part = hashes[a : a + 255 * 64]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 4) -> int:
    import xxhash

    digest, words = xxhash.xxh64_intdigest, text.lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return digest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return vote(np.fromiter((digest(line[a:b], 42) for a, b in pairs), np.uint64, len(words) - shingle + 1))


def fingerprints(docs: DataFrame, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fps = np.array([fingerprint(t, shingle) for t in utf8(batch.column("text"))], np.uint64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": fps.view(np.int64)})

    return bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """For each row with fp: key (segment, deleted bit, the segment's other bits) and all columns."""
    n = distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    keys = []
    for a, b in zip(cuts, cuts[1:]):
        part = F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b - a) - 1).cast("long"))
        # 6 bits for the deleted bit's place, which also tells the segment
        keys += [part.bitwiseAND(F.lit(((1 << b - a) - 1) & ~(1 << j)).cast("long")).bitwiseOR(F.lit((a + j) << 57 if a + j < 64 else 0).cast("long")) if b - a <= 57 else F.xxhash64(part.bitwiseAND(F.lit(((1 << b - a) - 1) & ~(1 << j)).cast("long")), F.lit(a + j)) for j in range(b - a)]
    return fps.select("*", F.explode(F.array(*keys)).alias("key"))


def forest(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that link what the exact links within each run of equal keys link. key is sorted."""
    n = len(key)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.empty(0, int)
    sizes = np.diff(np.append(starts, n))
    left, right = [], []
    small = np.repeat(sizes <= SMALL_RUN, sizes)
    for shift in range(1, min(SMALL_RUN, int(sizes.max(initial=1)))):
        i = np.flatnonzero((key[shift:] == key[:-shift]) & small[shift:])
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= distance]
        left.append(i)
        right.append(i + shift)
    for s, size in zip(starts[sizes > SMALL_RUN].tolist(), sizes[sizes > SMALL_RUN].tolist()):
        todo = np.arange(s, s + size)
        while len(todo):
            frontier, todo = [int(todo[0])], todo[1:]
            while frontier and len(todo):
                at = frontier.pop()
                near = np.bitwise_count(fp[todo] ^ fp[at]) <= distance
                if near.any():
                    found, todo = todo[near], todo[~near]
                    left.append(np.full(len(found), at))
                    right.append(found)
                    frontier += found.tolist()
    none = [np.empty(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


class Merged:
    """Union-find over what one task has seen, so that a link found in many buckets is told once."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, root)
        return root

    def add(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def links(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """nodes: rep (long), fp, one row per distinct fp. Edges a, b between reps that span, bucket by bucket,
    the same groups as all links of at most `distance` differing bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, n, enough = Merged(), [], 0, BLOCK_ROWS

        def work(key, fp, rep):
            i, j = forest(key, fp.view(np.uint64), distance)
            if len(seen.up) > 1_000_000:
                seen.up.clear()
            new = [(a, b) for a, b in zip(rep[i].tolist(), rep[j].tolist()) if seen.add(a, b)]
            if new:
                a, b = zip(*new)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep")])
            n += batch.num_rows
            if n >= enough:
                key, fp, rep = (np.concatenate(x) for x in zip(*held))
                whole = int(np.searchsorted(key, key[-1]))  # the last run may go on
                if whole:
                    yield from work(key[:whole], fp[:whole], rep[:whole])
                held, n = [[key[whole:], fp[whole:], rep[whole:]]], len(key) - whole
                enough = max(BLOCK_ROWS, 2 * n)  # a run that goes on is joined up again only once it has doubled
        if held:
            yield from work(*(np.concatenate(x) for x in zip(*held)))

    keyed = variants(nodes.select("rep", "fp"), distance)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 4, distance: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row of docs."""
    fps = materialize(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(links(nodes.where("rep is not null"), distance))
    named = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("fp"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: 4-word shingles, links at 4 or fewer differing bits, all documents."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
