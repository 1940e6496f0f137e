"""How many input splits one task should take."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Tasks per core, enough to even out their run times.
TASKS_PER_CORE = 4


def long_tasks(df: DataFrame) -> DataFrame:
    """Let each task read several splits, without a shuffle.

    A task of a bounded summary hands on up to the whole summary, so the shuffle grows with the
    number of tasks: a huge input cut in default splits would shuffle more cells than it has
    rows. Inputs with fewer partitions are left as they are.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.coalesce(max(TASKS_PER_CORE * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
