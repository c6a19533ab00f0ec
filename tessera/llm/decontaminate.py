"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-cased alphanumeric tokens. Each fixed mask picks some positions of a span and ignores the
others, so a hit survives substituted tokens. Item and document hashes under the same mask are matched by
equality; each hit gives a diagonal (document place - item place), on which all tokens of the item are
compared once. Runs of one hash (a token said again and again) meet as runs, so they cost their lengths' sum, not their
product. A document is contaminated by an item if some stretch of the diagonal, as long as `overlap` tokens
(or the whole item, if shorter), agrees in at least `similarity` of its tokens. The masks were chosen so that
every stretch of 13 tokens with up to two substitutions has a hit; items shorter than a mask are hit by their
whole token sequence.

The benchmark is handled in blocks of at most BLOCK_TOKENS tokens, each broadcast to one pass over the
documents; a benchmark of any size works, one pass a block. Documents are never shuffled for one block.

Null or tokenless texts and items never match. Repeated items are reported each; repeated documents are
judged alike. Empty tables give no contaminated rows. A null item_id is reported as -1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, chunks, materialize, utf8

MASKS = ((1, 1, 0, 1, 1), (1, 1, 1, 0, 1), (1, 0, 1, 1, 1), (1, 1, 1, 1))
OVERLAP, SIMILARITY = 13, 0.8
#: Tokens of a block of the benchmark; pairs of seed runs that are met at once.
BLOCK_TOKENS, HITS = 2_000_000, 1 << 19
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SEEDS = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def spaced(ids: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A hash of the picked tokens of every span; ids are the tokens' numbers."""
    n = len(ids) - len(mask) + 1
    out = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for k, on in enumerate(mask):
            if on and n > 0:
                x = (ids[k : k + n].astype(np.uint64) + np.uint64(1)) * _SEEDS[k]
                out = (out ^ x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out ^= out >> np.uint64(32)
    return out


class Block:
    """Seeds of some benchmark items. Only tokens that occur in an item get a number above 0."""

    def __init__(self, items: list[tuple[int, list[bytes]]], overlap: int, similarity: float):
        self.overlap, self.similarity = overlap, similarity
        self.vocabulary: dict[bytes, int] = {}
        self.items = [(i, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64)) for i, ws in items if ws]
        self.masks: list[tuple] = list(MASKS)
        widest = max(map(len, MASKS))
        self.masks += [(1,) * n for n in range(1, widest) if any(len(t) == n for _, t in self.items) and (1,) * n not in MASKS]
        self.tables = []
        for mask in self.masks:
            whole = mask not in MASKS
            seeds = sorted((h, k, p) for k, (_, t) in enumerate(self.items) if not whole or len(t) == len(mask) for p, h in enumerate(spaced(t, mask).tolist()))
            h = np.array([s[0] for s in seeds], np.uint64)
            bits = np.zeros(1 << 22, bool)
            bits[(h >> np.uint64(42)).astype(np.int64)] = True
            where = np.array([s[1:] for s in seeds], np.int64).reshape(-1, 2)
            # seeds with one hash at neighbouring places of an item are one run: item, first place, places
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (where[1:, 0] != where[:-1, 0]) | (where[1:, 1] != where[:-1, 1] + 1)
            heads = np.flatnonzero(new)
            runs = np.column_stack((where[heads], np.diff(np.append(heads, len(h)))))
            self.tables.append((mask, bits, h[heads], runs))

    def hits(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """The distinct (item, diagonal) of all seed hits in tokens laid end to end; token 0 is in no item."""
        found: list[np.ndarray] = []
        for mask, bits, seeds, runs in self.tables:
            if not len(seeds) or len(ids) < len(mask):
                continue
            h = spaced(ids, mask)
            at = np.flatnonzero(bits[(h >> np.uint64(42)).astype(np.int64)])
            # a span must lie in one text
            at = at[np.searchsorted(ends, at, side="right") == np.searchsorted(ends, at + len(mask) - 1, side="right")]
            new = np.ones(len(at), bool)
            new[1:] = (h[at[1:]] != h[at[:-1]]) | (at[1:] != at[:-1] + 1)
            heads = np.flatnonzero(new)
            times, at = np.diff(np.append(heads, len(at))), at[heads]
            first, last = np.searchsorted(seeds, h[at]), np.searchsorted(seeds, h[at], side="right")
            upto = np.cumsum(last - first)
            a = 0
            while a < len(at):  # about HITS pairs of runs at once
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HITS)))
                n = (last - first)[a:b]
                which = np.repeat(first[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
                item, place, long = runs[which].T
                low, width = np.repeat(at[a:b], n) - place - long + 1, np.repeat(times[a:b], n) + long - 1
                diagonal = np.repeat(low - np.cumsum(width) + width, width) + np.arange(width.sum())
                found.append(np.unique(np.repeat(item, width) << 40 | diagonal + (1 << 39)))
                a = b
        keys = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return list(zip((keys >> 40).tolist(), ((keys & (1 << 40) - 1) - (1 << 39)).tolist()))

    def verify(self, ids: np.ndarray, begin: int, end: int, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """The longest agreeing stretch of the item on the diagonal: start, length (tokens) and matches."""
        t = self.items[item][1]
        a, b = max(0, begin - diagonal), min(len(t), end - diagonal)
        least = min(self.overlap, len(t))
        if b - a < least:
            return None
        same = ids[a + diagonal : b + diagonal] == t[a:b]
        # longest stretch whose ends match with a share of matches of at least `similarity`
        gain = np.concatenate(([0.0], np.cumsum(same - self.similarity)))
        lowest = np.minimum.accumulate(gain)
        best = None
        for e in np.flatnonzero(same)[::-1].tolist():
            if best and e + 1 <= best[1]:
                break
            s = int(np.searchsorted(-lowest, -(gain[e + 1] + 1e-9)))
            if e + 1 - s >= least and (best is None or e + 1 - s > best[1]):
                best = (s, e + 1 - s, int(same[s : e + 1].sum()))
        return best and (best[0] + a + diagonal - begin, best[1], best[2])


MATCH = "struct<item_id:bigint,start:int,length:int,matched:int>"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("matched", pa.int32())]))


def blocks(benchmark: DataFrame, item_id: str, text: str, overlap: int, similarity: float) -> Iterator[Block]:
    held, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(item_id).cast("long"), F.lit(-1)).alias("i"), F.col(text).alias("t")).toLocalIterator():
        ws = words((row["t"] or "").encode())
        held.append((row["i"], ws))
        size += len(ws)
        if size > BLOCK_TOKENS:
            yield Block(held, overlap, similarity)
            held, size = [], 0
    yield Block(held, overlap, similarity)


def matches(docs: DataFrame, block: Block, text: str = "text") -> DataFrame:
    """docs (all columns) with __matches: the items of the block that contaminate the row."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        number = own.vocabulary.get
        for batch in chunks(batches, text):
            texts = [words(t) for t in utf8(batch.column(text))]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            ids = np.fromiter((number(w, 0) for ws in texts for w in ws), np.int64, int(lengths.sum()))
            ends = np.cumsum(lengths)
            found: list[dict] = [{} for _ in texts]
            for item, diagonal in own.hits(ids, ends):
                # the text that the diagonal's item overlaps most is one of those around its places
                for d in range(int(np.searchsorted(ends, max(0, diagonal), side="right")), len(texts)):
                    if ends[d] - lengths[d] >= diagonal + len(own.items[item][1]):
                        break
                    if (got := own.verify(ids, int(ends[d] - lengths[d]), int(ends[d]), item, diagonal)) and got[1] > found[d].get(item, (0, 0))[1]:
                        found[d][item] = got
            told = [[{"item_id": own.items[k][0], "start": s, "length": n, "matched": m} for k, (s, n, m) in sorted(f.items())] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, _KIND)], names=[*batch.schema.names, "__matches"])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return bounded(docs).mapInArrow(run, f"{fields}, __matches array<{MATCH}>")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", overlap: int = OVERLAP, similarity: float = SIMILARITY) -> DataFrame:
    """docs with __matches over all blocks."""
    out = None
    for block in blocks(benchmark, item_id, "text", overlap, similarity):
        if out is None:
            out = matches(docs, block, text)
        else:  # a further block: another pass over what the last one left
            got = matches(materialize(out.withColumnRenamed("__matches", "__before"), "blocks"), block, text)
            out = got.withColumn("__matches", F.concat("__before", "__matches")).drop("__before")
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: one row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("__matches") > 0).alias("contaminated"), F.col("__matches.item_id").alias("item_ids"), F.col("__matches").alias("matches"))
