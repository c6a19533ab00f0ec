"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Layout of a written corpus (a folder that all nodes mount):
  part-NNNNN.ids   token ids, little-endian unsigned, 16 bits wide if the vocabulary allows, else 32
  part-NNNNN.idx   int64 triples' columns: doc ids [n], then local offsets [n + 1]
  manifest.json    id width and, per part, documents, those without an id, tokens and base

Parts hold ascending ranges of doc_id, so file order is id order. A part's base is the prefix sum of the
tokens of the parts before it, taken from one row per part; a document's 64-bit position is base + local
offset. Writers use a name of their own and rename at the end, so a task that is run again or twice leaves
the same whole file.

Null texts are empty documents (only the end id). Documents with equal doc_id are kept, ordered by text.
Documents without an id come first; the manifest has their number per part. Empty tables give a manifest without parts.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, chunks, fresh_path, local_file, utf8
from tessera.llm.encoding import TEXT_BYTES, encoder


#: Bytes of the table for a part, and parts at most.
PART_BYTES, MOST_PARTS = 256 << 20, 1 << 20


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_bytes: int = 2, doc_id: str = "doc_id", text: str = "text") -> str:
    """Encodes docs and writes the files under `path`; returns `path`.

    The only shuffle is the range partitioning by doc_id that makes the order global."""
    folder = local_file(path)
    os.makedirs(folder, exist_ok=True)
    kind = {2: "<u2", 4: "<u4"}[id_bytes]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokens = TaskContext.get().partitionId(), encoder(tokenizer_path)
        own, ids, counts, nulls = f"{folder}/.{part:05d}-{uuid.uuid4().hex}", [], [], 0
        os.makedirs(folder, exist_ok=True)
        with open(f"{own}.ids", "wb") as out:
            for batch in chunks(batches, "text", TEXT_BYTES):
                flat, lengths = tokens.encode(utf8(batch.column("text")), end_id)
                if len(flat) and int(flat.max()) >= 1 << 8 * id_bytes:
                    raise ValueError(f"token id {flat.max()} needs more than {id_bytes} bytes")
                out.write(flat.astype(kind).tobytes())
                nulls += batch.column("doc_id").null_count
                ids.append(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                counts.append(lengths)
        ids, counts = np.concatenate(ids or [np.empty(0, "<i8")]), np.concatenate(counts or [np.empty(0, np.int64)])
        if not len(ids):
            os.remove(f"{own}.ids")
            return
        with open(f"{own}.idx", "wb") as out:
            out.write(ids.tobytes() + np.concatenate(([0], np.cumsum(counts))).astype("<i8").tobytes())
        for kind_of in ("ids", "idx"):
            os.replace(f"{own}.{kind_of}", f"{folder}/part-{part:05d}.{kind_of}")
        yield pa.record_batch({"part": [part], "docs": [len(ids)], "nulls": [nulls], "tokens": [int(counts.sum())]})

    rows = bounded(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(parts_for(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    parts = sorted(tuple(r) for r in rows.mapInArrow(write, "part long, docs long, nulls long, tokens long").collect())
    base, manifest = 0, {"id_bytes": id_bytes, "parts": []}
    for part, n, nulls, tokens in parts:
        manifest["parts"].append({"part": part, "docs": n, "nulls": nulls, "tokens": tokens, "base": base})
        base += tokens
    with open(f"{folder}/.manifest", "w") as out:
        json.dump(manifest, out)
    os.replace(f"{folder}/.manifest", f"{folder}/manifest.json")
    return path


def parts_for(docs: DataFrame) -> int:
    """About one part for PART_BYTES of the table, and at least as many as the session shuffles to. Spark's estimate is
    not trusted beyond MOST_PARTS: tables of unknown size have a huge one."""
    parts = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PART_BYTES
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts if parts <= MOST_PARTS else 1)


def open_part(folder: str, part: dict, id_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Memory-mapped doc ids, local offsets and token ids of one part."""
    name = f"{folder}/part-{part['part']:05d}"
    index = np.memmap(f"{name}.idx", "<i8", "r")
    return index[: part["docs"]], index[part["docs"] :], np.memmap(f"{name}.ids", {2: "<u2", 4: "<u4"}[id_bytes], "r") if part["tokens"] else np.empty(0, "<u2")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, read from the files: doc_id, start (64-bit position), n_tokens, ids_crc32."""
    folder = local_file(path)
    with open(f"{folder}/manifest.json") as f:
        manifest = json.load(f)
    width, schema = manifest["id_bytes"], "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest["parts"]:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                docs, offsets, ids = open_part(folder, row, width)
                for a in range(0, row["docs"], 4096):
                    b = min(a + 4096, row["docs"])
                    at = np.array(offsets[a : b + 1])
                    held = np.array(ids[at[0] : at[-1]]).astype("<u4")
                    crc = [zlib.crc32(held[i - at[0] : j - at[0]]) for i, j in zip(at[:-1], at[1:])]
                    known = pa.array(np.array(docs[a:b]), mask=np.arange(a, b) < row["nulls"])
                    yield pa.record_batch({"doc_id": known, "start": row["base"] + at[:-1], "n_tokens": np.diff(at), "ids_crc32": pa.array(crc, pa.int64())})

    parts = spark.createDataFrame([(p["part"], p["docs"], p["nulls"], p["tokens"], p["base"]) for p in manifest["parts"]], "part long, docs long, nulls long, tokens long, base long")
    return parts.repartition(len(manifest["parts"])).mapInArrow(read, schema)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract: every whole text of documents, end id 2, written in doc_id order and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(spark, write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2, fresh_path(spark, "token-files")))
