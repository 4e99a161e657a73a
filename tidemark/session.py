"""Session settings shared by tests, bench and the library entry points."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

#: Runtime settings that the plans are designed for; each is set only where the deployment says nothing.
RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "tidemark", partitions: int | None = None) -> SparkSession:
    """Local or cluster session. What the deployment configures stays as it is; ``partitions`` counts only where it names none."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        given = os.environ.get("PYSPARK_SUBMIT_ARGS", "")
        for key, value in (("spark.ui.enabled", "false"), ("spark.ui.showConsoleProgress", "false"),
                           ("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "16g"))):
            if key not in given and not (key == "spark.driver.memory" and "--driver-memory" in given):
                builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    set_by_deployment = {k for k, _ in spark.sparkContext.getConf().getAll()}
    wanted = RUNTIME_DEFAULTS | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    for key, value in wanted.items():
        if key not in set_by_deployment:
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder. Only a local master may go without one; it gets a fresh folder of its own."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current
