"""Cutting lineage between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a round's result.

    The directory is the cluster's shared ``spark.checkpoint.dir``.  Only where neither that nor a
    directory on the context is set, and the master is local, a temporary folder is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="docrecon-checkpoint-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)
