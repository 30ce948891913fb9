"""Tables that several steps read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(rows: DataFrame) -> DataFrame:
    """Rows that are made once for all later steps: written to the checkpoint folder that executors share (the session's
    spark.checkpoint.dir), or held by Spark, which can make them again, where none is set."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        told = context.getConf().get("spark.checkpoint.dir")
        if not told:
            return rows.persist()
        context.setCheckpointDir(told)
    return rows.checkpoint()


def made_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet a condition on what has just been made of them. A plain filter would be moved below the making of
    its columns, which would then be made twice."""
    return rows.select(F.explode_outer(F.array(F.when(condition, F.struct(*rows.columns)))).alias("row")).where("row is not null").select("row.*")
