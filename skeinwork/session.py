"""Session factory and the shared folder used to cut long lineages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "skeinwork", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that is there."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in (_DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a session, so that UDFs can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_skeinwork_shipped", False):
        return
    sc._skeinwork_shipped = True
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="skeinwork-")
    atexit.register(shutil.rmtree, folder, True)  # the driver serves it from there, also to executors that come later
    archive = Path(folder) / "skeinwork.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session.

    Only a local session may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="skeinwork-")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame, name: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: short lineage, survives lost executors.

    Parquet instead of checkpoint() keeps the files small, and filters and column selection still reach them. A table that
    `drop_cut` has not deleted by then is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skeinwork-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    target, fs = _file(spark, path)
    fs.deleteOnExit(target)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._skein_path = path
    return back


def drop_cut(df: DataFrame | None) -> None:
    """Delete the table behind a DataFrame that `cut` returned, once nothing reads it any more."""
    path = getattr(df, "_skein_path", None)
    if path is None:
        return
    spark = df.sparkSession
    target, fs = _file(spark, path)
    fs.delete(target, True)
    fs.cancelDeleteOnExit(target)


def shared_file(spark: SparkSession, name: str) -> str | None:
    """The local path of a new file in the shared folder for tables that Python workers map into memory; None if that folder
    is not mounted (an object store, say). It is deleted when the driver's JVM ends.
    """
    target, fs = _file(spark, f"{shared_dir(spark)}/skeinwork-{name}-{uuid.uuid4().hex}")
    if fs.getScheme() != "file":
        return None
    path = target.toUri().getPath()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).touch()
    fs.deleteOnExit(target)
    return path


def _file(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def default_parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

