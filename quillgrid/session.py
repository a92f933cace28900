"""Session defaults for tests, the bench and scripts; a cluster brings its own session."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Set by the cluster; a folder all executors share.
CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only on one machine (master ``local``)
    and where none is named, a temporary folder is set."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_KEY} names no folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillgrid-checkpoint-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there: the lineage ends here."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def apart(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles both sides. The planner takes exploded rows and results of
    loops for far smaller than they are, and would send them whole through the driver."""
    return df.hint("merge")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder. For loops that join
    their own results, some of which grew slower from round to round with checkpoints
    (likely by what the planner infers of columns, which a checkpoint keeps)."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/rounds-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
