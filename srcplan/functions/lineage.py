"""Cutting the lineage of iterations, so that they survive lost executors and their plans stay small."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that spark.checkpoint.dir names; only a local session may leave that unset, which then gets a temporary folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="srcplan-")
        spark.sparkContext.setCheckpointDir(path)
    kept = df.checkpoint()
    # a checkpoint keeps the estimate of its size, that of a join is a product, and after twenty rounds it has millions of digits
    jvm = spark._jsparkSession
    return DataFrame(jvm.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), spark)
