"""Row-local operators on a stream of documents. They keep no state, so the batch expressions serve unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.operators.rhythm import metrics
from inkwell.profiles import LATIN, Profile

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).parquet(folder)


def rhythm_stream(docs: DataFrame, profile: Profile = LATIN) -> DataFrame:
    """Rhythm metrics of each document as it arrives."""
    return metrics(docs, profile)
