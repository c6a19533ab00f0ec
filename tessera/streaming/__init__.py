"""Streaming entry points: the stateless stages run unchanged on a stream of records."""

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.normalize import normalize_records
from tessera.sources.tables import RAW, TSV, told_missing


def normalized_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Arriving tab-separated files as a stream of normalized records."""
    return normalize_records(told_missing(spark.readStream.schema(RAW).options(**TSV).csv(folder)))
