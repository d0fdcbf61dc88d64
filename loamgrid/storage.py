"""Tables on disk that cut lineage, and joins that broadcast only checked sizes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes on disk up to which a counted table may be broadcast.
BROADCAST_BYTES = 64 << 20
_marked: set[str] = set()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``, which all executors share; removed when the application ends.

    Where the setting is unset a folder of our own is used in local mode only: on a cluster each executor would
    write to its own disk, so that is an error.
    """
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loamgrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/loamgrid-{spark.sparkContext.applicationId}"
    if root not in _marked:
        at, fs = _file_system(spark, root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _marked.add(root)
    return root


def new_path(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes all staged tables of this application; call it when the results that read them are written."""
    at, fs = _file_system(spark, f"{shared_dir(spark)}/tables")
    fs.delete(at, True)


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file to the shared folder; its path."""
    path = f"{shared_dir(spark)}/files/{name}"
    at, fs = _file_system(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(data))
    out.close()
    return path


class Staged:
    """A table written to the shared folder; ``rows`` is its counted size, ``bytes`` its size on disk.

    Unlike a cached table it survives the loss of executors, and its lineage is a file scan. ``drop`` deletes it early; what is left
    goes with ``clean`` or the end of the application.
    """

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.spark, self.path = spark, new_path(spark)
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        self._rows: int | None = None

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.df.count()  # answered from the Parquet footers
        return self._rows

    @property
    def bytes(self) -> int:
        at, fs = _file_system(self.spark, self.path)
        return fs.getContentSummary(at).getLength()

    def drop(self) -> None:
        at, fs = _file_system(self.spark, self.path)
        fs.delete(at, True)


def broadcast_upto(staged: Staged, rows: int, df: DataFrame | None = None) -> DataFrame:
    """Hints a broadcast of the table (or of ``df``, rows of it) only if it has at most ``rows`` rows and BROADCAST_BYTES on disk.

    Beyond that Spark shuffles, and AQE splits skew.
    """
    out = staged.df if df is None else df
    return F.broadcast(out) if staged.rows <= rows and staged.bytes <= BROADCAST_BYTES else out
