"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Settings the results depend on: every timestamp is read and printed in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark. Clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("opsignal")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # recording the call site of every column expression makes plan building several times slower
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session may run without the setting; it then gets a new temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="opsignal-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has written to yet."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the file system that Spark would take it from: a bare path belongs to the default one."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder as Parquet and read back: computed once, pruned by column, of known size."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later passes read files and survive executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
