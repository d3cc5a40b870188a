"""Session and scratch-space helpers shared by the library."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "folioframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; a session that already runs is reused as it is."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # what a cut wrote goes when nothing refers to it any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it. Where none is set, one of our own, on a machine that is
    its own cluster (a local master); elsewhere that raises, as other machines could not read it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioframe-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that a lost executor costs no recomputation.

    What df was computed from isn't needed any more. Spark deletes shuffle files when the driver's garbage is collected,
    which an idle driver seldom does by itself; asked for here, a chain of steps needs the disk of its largest
    step, not that of all."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    df = df.checkpoint(eager=True)
    spark._jvm.System.gc()
    return df
