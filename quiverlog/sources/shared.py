"""Tables cut from their lineage, in the folder that the driver and the executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Tables of this process lie in a folder of its own, so that ``release_tables`` takes no others.
_RUN = uuid.uuid4().hex
#: Parts of a growing set that are read together before they are merged.
MOST_PARTS = 16


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where none is named and all runs on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _own:
        _own["root"] = tempfile.mkdtemp(prefix="quiverlog-graph-")
        atexit.register(shutil.rmtree, _own["root"], True)
    return f"file://{_own['root']}"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quiverlog-graph/{_RUN}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its object."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def release_tables(spark: SparkSession) -> None:
    """Remove every intermediate table of this process: for when its answers have been written and its stores saved."""
    system, target = file_system(spark, _folder(spark))
    system.delete(target, True)


def write_table(df: DataFrame, tag: str) -> str:
    path = f"{_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, tag))


class Growing:
    """A set that grows by rounds: a round writes its new rows only, and all parts are read together."""

    def __init__(self, first: DataFrame, tag: str):
        self.spark, self.schema, self.tag = first.sparkSession, first.schema, tag
        self.paths = [write_table(first, tag)]

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)

    def add(self, fresh: DataFrame) -> DataFrame | None:
        """Write rows that the set doesn't have; what was written, or None where there was nothing."""
        path = write_table(fresh.select(*self.schema.names), self.tag)
        part = self.spark.read.schema(self.schema).parquet(path)
        if part.isEmpty():
            return None
        self.paths.append(path)
        if len(self.paths) > MOST_PARTS:
            self.paths = [write_table(self.frame(), self.tag)]
        return part


def local_table(spark: SparkSession, rows, names: list[str]) -> DataFrame:
    """Strings that the driver holds, as a local relation: the optimizer knows its size and filters it while planning."""
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.string()) for n, c in zip(names, columns)}))
