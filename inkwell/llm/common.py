"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of code points other than U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a local session (as in tests) takes a
    temporary folder of this machine, which its only JVM sees; on a cluster that is an error."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if made is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="inkwell-"))
        made = spark.sparkContext.getCheckpointDir()
    return made.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, which outlive executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of the value written as text, modulo n (null stays null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_lookup(rows: DataFrame, small: DataFrame, key: str, salt_by: str, salts: int = 32) -> DataFrame:
    """Left join of rows with one row for each key, null-safe; each key's rows are dealt over ``salts`` tasks."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)))
    right = small.withColumnRenamed(key, "_key").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    on = left[key].eqNullSafe(right["_key"]) & (left["_salt"] == right["_salt"])
    return left.join(right, on, "left").drop("_key", "_salt")


def free_name(rows: DataFrame, name: str) -> str:
    """A column name that rows don't have."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name
