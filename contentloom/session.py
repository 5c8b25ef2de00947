"""Session settings and stage tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", name: str = "contentloom") -> SparkSession:
    """A session for tests and benches. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.contentloom.parse.tasks", "8" if cores == "*" else str(cores))
        .getOrCreate()
    )


def stage_folder(spark: SparkSession) -> str:
    """The shared folder for stage tables, as the cluster names it in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="contentloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_STAGED: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back. This runs a job at once, while a plan is built.

    Cuts the lineage, so a lost executor costs a re-read and not a second parse of the
    crawl, and lets every later reader take only the columns it needs.
    """
    path = f"{stage_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged() -> list[str]:
    """Paths of the stage tables that this process has written and not removed."""
    return list(_STAGED)


def remove_stages(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete stage tables of this process, all or those at the paths, once the results that read
    them are written. Returns how many."""
    gone = [p for p in _STAGED if paths is None or p in paths]
    for path in gone:
        _STAGED.remove(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(gone)
