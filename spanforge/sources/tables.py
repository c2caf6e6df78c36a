"""Tables of a data folder and files in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``, a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one on a session of one machine, and an error on any other."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        root = spark.conf.get("spanforge.shared.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spanforge_")
        spark.conf.set("spanforge.shared.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    own = f"{shared_dir(spark)}/spanforge/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return own


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, for as long as the application runs."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_file(spark: SparkSession, uri: str, content: bytes) -> str:
    """Write a file wherever Spark can; gives its whole address."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        step = 1 << 22
        for at in range(0, len(content), step):
            out.write(content[at : at + step])
    finally:
        out.close()
    return fs.makeQualified(path).toString()


def read_file(spark: SparkSession, uri: str) -> bytes | None:
    """The content of a file wherever Spark can read it, or None where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return bytes(spark.read.format("binaryFile").load(uri).select("content").first()[0])


def ship_file(spark: SparkSession, label: str, content: bytes) -> str:
    """Put ``content`` into the shared folder and have each executor fetch it once; gives the name for ``SparkFiles.get``."""
    name = f"{label}-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(write_file(spark, f"{_own_dir(spark)}/files/{name}", content))
    return name


def stream_parquet(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A streaming read of a parquet folder, or of a single file (which the file source takes only by way of its folder)."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
