"""Session helper for tests, benches and notebooks.  On a cluster, pass your own session instead."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_TEST_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cpus: int | str = "*", app: str = "isolens") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ISOLENS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    Where the session names none, local mode gets a test folder, the same for the whole session;
    a cluster is refused, since its executors would not share such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _TEST_FOLDERS:
        _TEST_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return _TEST_FOLDERS[app]


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes when the driver ends, where the session can be asked for that."""
    path = f"{shared_folder(spark)}/isolens-{uuid.uuid4().hex}/{name}"
    jvm = getattr(spark, "_jvm", None)  # a Connect session has none: there the folder's owner clears it
    if jvm is not None:
        top = jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
        top.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(top)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder. Unlike a checkpoint it carries no constraints of its plan, which grow fast where a loop builds on itself.

    A ``large`` table, of the size of the input, is packed more tightly, and the driver is asked to collect its garbage
    after that, which makes executors delete the shuffle files behind it.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    (df.write.option("compression", "zstd") if large else df.write).parquet(path)
    jvm = getattr(spark, "_jvm", None)
    if large and jvm is not None:
        jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for functions that run there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))


def spread(df: DataFrame, *cols) -> DataFrame:
    """One partition per core for few rows with heavy work each, which size-based coalescing would pack into one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *cols)


#: Bytes of input files that one partition stands for where rows are dealt out by ``by_size``.
PART_BYTES = 8 << 20


def input_bytes(df: DataFrame) -> int:
    """Size of the files that ``df`` reads; 0 where it reads none, or a Connect session cannot tell."""
    spark = df.sparkSession
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return 0
    conf = spark._jsc.hadoopConfiguration()
    paths = (jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles())
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def by_size(df: DataFrame, *cols) -> DataFrame:
    """``df`` dealt out by ``cols`` into as many partitions as its input files need, so what one task holds does not grow with them.

    Aggregations on these and more columns need no further shuffle, nor a map side that holds rows hardly any of which combine.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // PART_BYTES))
    return df.repartition(n, *cols)
