"""Small tables laid beside a large one: one Arrow file for each part of the large table, in the shared folder.

A large table whose rows' key says in which part they were written (`key >> bits`) can so be met by what was found out about
its rows without being shuffled: the few bytes go to the part, the part's rows stay where they are. A file is written
under a name of its own and renamed, so a task that runs twice does no harm. Parts without rows have no file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, fresh_path, local_file

#: Bits of a key below those of the part: in batch numbers, and in Spark's monotonically_increasing_id.
PART_BITS, ROW_BITS = 32, 33


def lay(rows: DataFrame, name: str, key: str = "batch", bits: int = PART_BITS) -> str:
    """Writes rows as one file for each part, ordered by key. Returns the folder."""
    folder = local_file(fresh_path(rows.sparkSession, name))
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0

        def out() -> None:
            own = f"{folder}/.{uuid.uuid4().hex}"
            with pa.ipc.new_file(own, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as f:
                f.write_table(pa.Table.from_batches(held).combine_chunks())
            os.replace(own, f"{folder}/{now}.arrow")

        for b in batches:
            parts = b.column(key).to_numpy() >> bits
            cuts = np.flatnonzero(parts[1:] != parts[:-1]) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if a < z:
                    if held and parts[a] != now:
                        out()
                        held = []
                    now = int(parts[a])
                    held.append(b.slice(a, z - a))
            n += b.num_rows
        if held:
            out()
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    rows.repartition(F.shiftright(key, bits)).sortWithinPartitions(key).mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


@lru_cache(maxsize=4)
def _opened(folder: str, part: int, key: str) -> tuple[np.ndarray, pa.Table] | None:
    try:
        with pa.OSFile(f"{folder}/{part}.arrow") as f:
            rows = pa.ipc.open_file(f).read_all()
    except FileNotFoundError:
        return None
    return rows.column(key).to_numpy(), rows


def beside(folder: str, batch: int) -> pa.Table | None:
    """The rows laid beside a batch (null: the part has none)."""
    if (found := _opened(folder, batch >> PART_BITS, "batch")) is None:
        return None
    a, b = np.searchsorted(found[0], [batch, batch + 1]).tolist()
    return found[1].slice(a, b - a)


def places(folder: str, keys: np.ndarray, key: str, bits: int = ROW_BITS) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """For each part that the keys (distinct in the table) fall into: which of them have a row beside them, and these rows."""
    parts = keys >> bits
    for part in np.unique(parts).tolist():
        if (found := _opened(folder, part, key)) is not None:
            own = np.flatnonzero(parts == part)
            at = np.minimum(np.searchsorted(found[0], keys[own]), len(found[0]) - 1)
            hit = found[0][at] == keys[own]
            yield own[hit], found[1].take(at[hit])


def without(rows: DataFrame, folder: str, key: str, bits: int = ROW_BITS) -> DataFrame:
    """The rows that have nothing laid beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for own, _ in places(folder, batch.column(key).to_numpy(), key, bits):
                keep[own] = False
            yield batch.filter(pa.array(keep))

    return bounded(rows).mapInArrow(run, rows.schema)
