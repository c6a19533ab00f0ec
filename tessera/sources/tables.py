"""Typed readers and writers."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import shared_folder

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])
CANDIDATES = T.StructType([T.StructField("source1_entity_id", T.StringType()), T.StructField("candidate_id", T.StringType()), T.StructField("name_score", T.DoubleType()), T.StructField("addr_score", T.DoubleType()), T.StructField("numeric_match", T.IntegerType()), T.StructField("source", T.StringType())])
#: Texts that a reader of tab-separated files takes for missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


TSV = {"sep": "\t", "header": True, "quote": '"', "escape": '"'}


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RAW, line_breaks: bool = False) -> DataFrame:
    """A1: header, quotes; MISSING becomes null. All columns are read as the schema says. line_breaks: quoted texts may
    hold line breaks, and a file is then one task."""
    return told_missing(spark.read.schema(schema).options(**TSV, multiLine=line_breaks).csv(path))


def told_missing(df: DataFrame) -> DataFrame:
    schema = df.schema
    return df.select(*[F.when(F.col(f.name).isin(*MISSING), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema])


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None, country: str | None = None) -> DataFrame:
    """A2-A4: a Parquet scan of some columns, of one country if asked; both reach the scan."""
    df = spark.read.parquet(path)
    df = df if country is None else df.where(F.col("country") == country)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, by_country: bool = False) -> None:
    """A5; by_country lays files out so that a country filter prunes folders."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("country") if by_country else writer).parquet(path)


def write_tsv(df: DataFrame, path: str, single: bool = False) -> None:
    """Header, empty text for empty lists."""
    (df.coalesce(1) if single else df).write.mode("overwrite").options(**TSV, emptyValue="", nullValue="").csv(path)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def cached(spark: SparkSession, folder: str, name: str, config: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """Load or compute. The path holds a fingerprint of the configuration, so a changed one is computed anew."""
    path = f"{folder}/{name}-{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]}"
    files, done = _hadoop(spark, f"{path}/_SUCCESS")
    if not files.exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def version(spark: SparkSession, path: str) -> list:
    """Path, bytes, files and time of the last change of a table: what a cache's fingerprint needs to know of its input."""
    files, at = _hadoop(spark, path)
    summary = files.getContentSummary(at)
    return [path, summary.getLength(), summary.getFileCount(), files.getFileStatus(at).getModificationTime()]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: computed once, however often later steps read it, and not
    computed again when an executor is lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty_candidates(spark: SparkSession) -> DataFrame:
    """A11."""
    return spark.createDataFrame([], CANDIDATES)
