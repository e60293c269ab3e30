"""Session helpers: scratch space that every executor can reach, and small plan utilities."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Settings the plans are written for; the rest is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    On a cluster it is what ``spark.checkpoint.dir`` names, and an error if that is unset. Only a local master may do
    without: a temporary folder is then made once per session and removed at exit.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = getattr(spark.sparkContext, "_meterflow_dir", None)
        if path is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
            path = tempfile.mkdtemp(prefix="meterflow-")
            spark.sparkContext._meterflow_dir = path
            atexit.register(shutil.rmtree, path, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table; ``release`` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch(spark)[0].append(path)
    return path


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh name for an intermediate table of the session's catalog; ``release`` drops it."""
    table_name = f"{name}_{uuid.uuid4().hex[:12]}"
    _scratch(spark)[1].append(table_name)
    return table_name


def _scratch(spark: SparkSession) -> tuple[list[str], list[str]]:
    sc = spark.sparkContext
    if not hasattr(sc, "_meterflow_scratch"):
        sc._meterflow_scratch = ([], [])
    return sc._meterflow_scratch


def scratch_names(spark: SparkSession) -> list[str]:
    """Names of catalog tables that ``release`` drops."""
    return _scratch(spark)[1]


def release(spark: SparkSession) -> int:
    """Remove the intermediate tables and files made so far in this application; returns how many.

    To be called between jobs, when no relation that was made before is read any more: relations are lazy, so only the caller
    knows when their readers are done.
    """
    paths, tables = _scratch(spark)
    count = len(paths) + len(tables)
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in paths:
        files, target = _at(spark, path)
        files.delete(target, True)
    paths.clear()
    tables.clear()
    return count


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _write(spark: SparkSession, path: str, body: bytes) -> None:
    files, target = _at(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on whatever file system ``path`` names."""
    _write(spark, path, text.encode())


def read_text(spark: SparkSession, path: str) -> str | None:
    """Its content; None if there is no such file."""
    files, target = _at(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def shipped(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, wherever the driver found it; once per context.

    The package travels as an archive in the shared folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_meterflow_shipped", False):
        return spark
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    if root.is_dir():
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        target = f"{shared_dir(spark)}/meterflow-{uuid.uuid4().hex[:12]}.zip"
        _write(spark, target, packed.getvalue())
        sc.addPyFile(target)
    sc._meterflow_shipped = True
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


PARTITION_BYTES = 256 * 1024 * 1024
UNKNOWN_BYTES = 10**16  # Spark's estimate for relations it knows nothing of lies far beyond


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Number of partitions or buckets where adaptive execution cannot choose it: the session's, or more if the
    estimated size of ``df`` asks for more. ``df`` should hold no join, whose estimate is a product. A size that is not
    known counts as nothing."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df is None:
        return least
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > UNKNOWN_BYTES:
        return least
    return max(least, -(-size // PARTITION_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that no column of ``df`` has, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; naive timestamps are taken as UTC instants."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
