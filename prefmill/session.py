"""Session settings and the shared folder for checkpoints and scratch tables."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster job wants; shuffle partitions are an upper bound that AQE coalesces at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows here are often small and costly to compute, so coalescing may keep small partitions while cores are free.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64kb",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Building a column otherwise records the Python call site each time, which dominates planning of wide expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}

TEXT_ROWS = 2000

# Scratch tables are read by their own job only and need neither a mark of success nor, on a local file system, files of
# checksums. There each of them would cost processes that set its mode, started from a JVM whose memory they share at first.
SCRATCH = {
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def build_session(master: str | None = None, partitions: int | None = None, **extra) -> SparkSession:
    """A session with the settings above. The number of shuffle partitions is set for local masters only (8 unless given);
    on a cluster it stays what the cluster or the caller says."""
    builder = SparkSession.builder.appName("prefmill")
    if master:
        builder = builder.master(master)
    if partitions is None and (master or "").startswith("local"):
        partitions = 8
    shuffle = {} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)}
    for key, value in {**SETTINGS, **shuffle, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session without one gets its own folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp" if os.path.isdir("/tmp") else None)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write to the shared folder and read back: fixes nondeterministic columns, cuts the lineage, survives lost
    executors, and gives later joins a known size."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**SCRATCH).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """From now on the session hands ``TEXT_ROWS`` rows to Python at once, unless it was told a number. Rows that are whole
    documents make Spark's usual batch tens of megabytes, held several times on either side of each task."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, TEXT_ROWS)


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark reaches; none if there is no such folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(hadoop)] if system.exists(hadoop) else []


def spread(df: DataFrame) -> DataFrame:
    """Give a scan that comes in fewer partitions than there are cores one partition per core; a larger scan stays as
    it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def gathered(df: DataFrame) -> DataFrame:
    """Partitions joined without a shuffle until there are four for each core, or a sixteenth of a shuffle's if that is more;
    fewer stay as they are. For results that are small beside the number of partitions: every file written costs tasks of
    later reads, and on a local file system processes that set its mode and those of its folders."""
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, width(spark) // 16))


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle whose number AQE must keep because the work grows after it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
