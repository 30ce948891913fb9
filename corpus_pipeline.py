"""A corpus pipeline of five stages: host-level quality rules, near-dedup, personal data, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows
with a null doc_id, and rows that share one, are documents like others.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import byte_bpe, host_rules, mixing, near_dedup, personal_data
from inkwell.llm.common import WORD, free_name, new_folder, table


def _identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column, whose name is given, that tells its documents apart: doc_id where it is one row's alone, else a
    hash of doc_id, text and source. Rows equal in these three share it."""
    name = free_name(docs, "row_id")
    several = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id")
    if several.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), name
    marked = several.select(F.col("doc_id").alias(f"{name}_of"))
    joined = docs.join(marked, docs["doc_id"].eqNullSafe(marked[f"{name}_of"]), "left").withColumn(name, F.col("doc_id").isNull() | F.col(f"{name}_of").isNotNull()).drop(f"{name}_of")
    return joined.withColumn(name, F.when(F.col(name), F.xxhash64("doc_id", "text", "source")).otherwise(F.col("doc_id").cast("long"))), name


def _kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """Identified rows that ``judge``, given documents whose doc_id is the row's, keeps; and the column of the row's id."""
    known, name = _identified(docs)
    told = judge(known.select(F.col(name).alias("doc_id"), "text", "source")).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return known.join(told, name, "left_semi"), name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules keep.

    Null and empty texts have no words and go; long texts are judged whole. Rows that share a doc_id are judged one by
    one, equal rows alike. An empty table gives an empty one; further columns stay, whatever their names.
    """
    return _kept(docs, host_rules.host_rules)[0].select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the least id: five-word shingles, similarity of 0.8 or more.

    Null and empty texts are near nothing and stay. Rows that share a doc_id are told apart by their texts: unlike ones
    all stay, of equal ones the least by its other columns. Otherwise as quality_rules.
    """
    kept, name = _kept(docs, near_dedup.near_dedup)
    again = kept.where(F.col("text").rlike(WORD)).groupBy(name).count().where("count > 1").select(name)
    if again.isEmpty():
        return kept.select(docs.columns)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = kept.join(again, name, "left_semi").groupBy(name).agg(F.min_by(whole, F.to_json(whole)).alias(name + "_"))
    return kept.join(again, name, "left_anti").select(docs.columns).unionByName(one.select(f"{name}_.*"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans replaced by their kind; n_chars follows the text.

    A null text stays null, with a null n_chars; an empty one stays empty. Every row stays, repeated ones too. An empty
    table gives an empty one; further columns stay, whatever their names.
    """
    return personal_data.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without words (null, empty) are taken 0 times. Rows that share a doc_id are drawn one by one, equal rows alike.
    A null source is one source. An empty table gives an empty one; further columns stay, whatever their names.
    """
    known, name = _identified(docs)
    copies = mixing.mix(known.select(F.col(name).alias("doc_id"), "text", "source")).where("copies > 0").groupBy(F.col("doc_id").alias(name)).agg(F.max("copies").alias(name + "_copies"))
    taken = known.join(copies, name)
    return taken.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name + "_copies")))).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of the bytes they decode to: doc_id, n_tokens, ids, decoded_sha256.

    A row for each row, repeated ones too; null and empty texts have no ids. Very long texts and words are encoded whole.
    An empty table gives an empty one; further columns are left out.
    """
    coded = byte_bpe.encode(docs, byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", dedup),
    ("personal_data", remove_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: Near-duplicate components, the draw of the mix and the folded encoding have no SQL form; tests compare run() with a
#: version in plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.schema(docs.schema).parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
