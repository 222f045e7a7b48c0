"""Tables cut from their lineage, written in the folder that all executors share."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of an action are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset a local session takes a temporary one; on a cluster
    that would be a disk of each machine, so an error says what to set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="wayline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    The written table replaces the lineage: losing an executor afterwards costs no recomputation. The shuffle files of
    the write go at its end; otherwise they stay until the driver happens to collect its garbage.
    """
    path = f"{shared_dir(df.sparkSession)}/wayline-{label}-{uuid.uuid4().hex}"
    before = df.sparkSession.conf.get(CLEANUP)
    df.sparkSession.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialise() wrote and nothing needs any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/wayline-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def scratch():
    """A materialise() whose tables go when the block ends: its last act must be to write what it returns with materialise() itself."""
    held: list[DataFrame] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        held.append(materialise(df, label))
        return held[-1]

    try:
        yield keep
    finally:
        for df in held:
            discard(df)
