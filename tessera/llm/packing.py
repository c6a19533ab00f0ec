"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Every item is a vector (tokens, 1 segment, loss tokens) relative to the limits. A sequence is filled by the
dot-product heuristic: of the items that still fit, take the one whose vector has the largest product with
the room left, each dimension weighted by its share of all demand. When nothing fits and more than `slack`
tokens of room are left, the longest item is cut to fill it. Documents longer than a sequence give whole
sequences first. What is left at the end of a partition is cut at powers of two, which need no padding.

Packing is local to a partition and works on at most `buffer_tokens` tokens at once: no shuffle, bounded
memory, and a task that is run again gives the same sequences.

Null texts are empty documents (one end id). Repeated rows are packed as often as they occur. Empty tables
give no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, chunks, utf8
from tessera.llm.encoding import TEXT_BYTES, encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass(frozen=True)
class Item:
    """A piece of a document: ids[0] is the document's id number `start`. Ids from loss_from on bear loss."""

    doc: int | None
    start: int
    ids: np.ndarray
    total: int
    loss_from: int = 0

    @property
    def loss(self) -> int:
        return min(len(self.ids), max(0, self.start + len(self.ids) - self.loss_from))

    def cut(self, n: int) -> tuple[Item, Item]:
        return Item(self.doc, self.start, self.ids[:n], self.total, self.loss_from), Item(self.doc, self.start + n, self.ids[n:], self.total, self.loss_from)

    def most(self, tokens: int, loss: int) -> int:
        """How many leading ids fit into so much room."""
        free = max(0, self.loss_from - self.start)
        return min(len(self.ids), tokens, free + loss)


class Pool:
    """Items by their vector; equal vectors are one kind."""

    def __init__(self, limits: Limits):
        self.limits, self.kinds, self.stacks = limits, {}, []
        self.vectors, self.counts = np.empty((64, 3)), np.zeros(64, np.int64)

    def add(self, item: Item) -> None:
        key = (len(item.ids), item.loss)
        if key not in self.kinds:
            k = self.kinds[key] = len(self.stacks)
            self.stacks.append([])
            if k == len(self.counts):
                self.vectors, self.counts = np.resize(self.vectors, (2 * k, 3)), np.concatenate((self.counts, np.zeros(k, np.int64)))
            self.vectors[k] = key[0] / self.limits.tokens, 1 / self.limits.segments, key[1] / self.limits.loss
        k = self.kinds[key]
        self.stacks[k].append(item)
        self.counts[k] += 1

    def __bool__(self) -> bool:
        return bool(self.counts.any())

    def _pop(self, k: int) -> Item:
        self.counts[k] -= 1
        return self.stacks[k].pop()

    def weights(self) -> np.ndarray:
        n = len(self.stacks)
        return (self.vectors[:n] * self.counts[:n, None]).sum(0) / max(1, self.counts.sum())

    def best(self, room: np.ndarray, weights: np.ndarray) -> Item | None:
        n = len(self.stacks)
        v = self.vectors[:n]
        fits = (self.counts[:n] > 0) & (v <= room + 1e-12).all(1)
        if not fits.any():
            return None
        return self._pop(int(np.argmax(np.where(fits, v @ (weights * room), -1.0))))

    def longest(self) -> Item:
        n = len(self.stacks)
        return self._pop(int(np.argmax(np.where(self.counts[:n] > 0, self.vectors[:n, 0], -1.0))))


def fill(pool: Pool, limits: Limits, slack: int) -> tuple[list[Item], bool]:
    """One sequence from the pool, and whether the pool could not fill it."""
    room, chosen, weights = np.ones(3), [], pool.weights()
    unit = np.array([limits.tokens, limits.segments, limits.loss], float)
    while pool:
        item = pool.best(room, weights)
        if item is None:
            tokens, segments, loss = np.rint(room * unit).astype(int)
            if segments < 1 or tokens <= slack:
                return chosen, False
            item = pool.longest()
            n = item.most(int(tokens), int(loss))
            if n < 1 or (n <= slack and chosen):
                pool.add(item)
                return chosen, False
            item, rest = item.cut(n)
            if len(rest.ids):
                pool.add(rest)
        chosen.append(item)
        room = np.maximum(room - np.array([len(item.ids), 1, item.loss]) / unit, 0)
    return chosen, bool(np.rint(room[0] * limits.tokens) > 0)


def at_powers_of_two(items: list[Item]) -> Iterator[list[Item]]:
    """Cuts the items, laid end to end, into sequences whose lengths are the powers of two of their sum."""
    left, items = sum(len(x.ids) for x in items), list(items)
    while left:
        size = 1 << left.bit_length() - 1
        left, out = left - size, []
        while size:
            item = items.pop(0)
            if len(item.ids) > size:
                item, rest = item.cut(size)
                items.insert(0, rest)
            out.append(item)
            size -= len(item.ids)
        yield out


def packed(items: Iterator[Item], limits: Limits, slack: int, buffer_tokens: int) -> Iterator[list[Item]]:
    pool, held = Pool(limits), 0

    def drain(last: bool) -> Iterator[list[Item]]:
        nonlocal pool, held
        rest: list[Item] = []
        while pool:
            chosen, short = fill(pool, limits, slack)
            if short:
                rest = chosen
            else:
                yield chosen
        if last and rest:
            yield from at_powers_of_two(rest)
            rest = []
        pool, held = Pool(limits), sum(len(x.ids) for x in rest)
        for x in rest:
            pool.add(x)

    for item in items:
        while len(item.ids) > (n := item.most(limits.tokens, limits.loss)):
            piece, item = item.cut(n)
            yield [piece]
        if n == limits.tokens:
            yield [item]
            continue
        pool.add(item)
        held += len(item.ids)
        if held >= buffer_tokens:
            yield from drain(False)
    yield from drain(True)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, limits: Limits = Limits(), slack: int = 16, buffer_tokens: int = 1 << 20, doc_id: str = "doc_id", text: str = "text", loss_from: str | None = None) -> DataFrame:
    """Packs the texts' ids; one row per piece. `ids` are little-endian unsigned 32-bit. loss_from names a
    column with the number of leading ids that bear no loss (null or None: all ids bear loss)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, first = encoder(tokenizer_path), TaskContext.get().partitionId() << 40

        def items() -> Iterator[Item]:
            for batch in chunks(batches, "text", TEXT_BYTES):
                flat, lengths = tokens.encode(utf8(batch.column("text")), end_id)
                ends = np.cumsum(lengths)
                for doc, free, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("free").to_pylist(), (ends - lengths).tolist(), ends.tolist()):
                    yield Item(doc, 0, flat[a:b].astype("<u4"), b - a, free)

        rows, held = [], 0
        for k, sequence in enumerate(packed(items(), limits, slack, buffer_tokens)):
            offset, total = 0, sum(len(x.ids) for x in sequence)
            padded = total if total & (total - 1) == 0 else limits.tokens
            for x in sequence:
                rows.append((x.doc, x.start, len(x.ids), x.ids.tobytes(), x.total, first + k, offset, padded))
                offset += len(x.ids)
            held += total
            if held > 1 << 19 or len(rows) > 8192:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)

    free = F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(0).cast("long")
    return bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), free.alias("free")).mapInArrow(run, SCHEMA)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: all documents, end id 1, sequences of at most 2048 ids."""
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length")
