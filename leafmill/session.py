"""Session, table reading and lineage cutting shared by every operator."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("leafmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where the setting is absent and everything runs in one process, as in tests, a temporary folder is
    made; a cluster without the setting is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="leafmill-", dir=os.environ.get("TMPDIR"))
        spark.conf.set("spark.checkpoint.dir", given)
    return given


_dropped: set[str] = set()


def _drop_at_end(spark: SparkSession, folder: str) -> None:
    """Has the folder deleted when the application ends."""
    if folder not in _dropped:
        _dropped.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends here.

    A lost executor costs nothing, as the files outlive it; they go when the application ends. Columnar and compressed, so it is a
    fraction of a checkpoint's size and later readers take only the columns they use.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/leafmill/{spark.sparkContext.applicationId}"
    _drop_at_end(spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_leafmill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="leafmill-code-")
    archive = shutil.make_archive(os.path.join(folder, "leafmill_package"), "zip", os.path.dirname(root), os.path.basename(root))
    sc.addPyFile(archive)
    sc._leafmill_shipped = True
