"""Session settings the pipeline relies on, and the shared folder it may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def pin_session(spark: SparkSession) -> SparkSession:
    """Fix the settings that change results: strict date parsing, text partition values, UTC.

    The last setting is for speed: the JVM never compiles methods of more than 8000 bytes, which the
    long projections here would give when fused into one; Spark then uses its split-up form instead.
    """
    spark.conf.set("spark.sql.legacy.timeParserPolicy", "CORRECTED")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder name below the checkpoint folder of the cluster, which every executor can reach.

    Only a local session without that setting gets a temporary folder; on a cluster this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        root = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/millrace/{label}-{uuid.uuid4().hex}"
