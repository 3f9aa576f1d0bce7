"""Intermediate tables in the folder that all executors share, and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_shipped: set[str] = set()
_open: list[list[Scratch]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a folder of this machine for a session that
    runs on this machine alone; on a cluster that is an error, since executors would not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _folders:
        _folders[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='grovewise-')}"
        _delete_at_end(spark, _folders[context.applicationId])
    return _folders[context.applicationId]


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete_at_end(spark: SparkSession, path: str) -> None:
    at, files = _path(spark, path)
    files.deleteOnExit(at)


class Scratch:
    """Tables written to the shared folder: they cut the lineage and survive the loss of an executor.

    ``keep`` writes a DataFrame and reads it back. ``drop`` deletes tables that nothing reads any more,
    ``close`` all of them. Results of operators read from such tables, so what is still there goes at the
    end of the enclosing ``scope``, or else when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/grovewise-{uuid.uuid4().hex}"
        self.made = 0
        if _open:
            _open[-1].append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        if not self.made:
            _path(self.spark, self.root)[1].mkdirs(_path(self.spark, self.root)[0])
            _delete_at_end(self.spark, self.root)
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def _delete(self, path: str) -> None:
        at, files = _path(self.spark, path)
        files.delete(at, True)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                self._delete(path)

    def close(self) -> None:
        if self.made:
            self._delete(self.root)


def kept(table: DataFrame) -> bool:
    """Whether ``table`` is one that a ``Scratch`` wrote, which costs no more to read again."""
    return hasattr(table, "_scratch_path")


@contextmanager
def scope() -> Iterator[None]:
    """Intermediate tables made within are deleted at its end; results must be written or collected before."""
    _open.append([])
    try:
        yield
    finally:
        for scratch in _open.pop():
            scratch.close()


def ship_package(spark: SparkSession) -> None:
    """This package on all executors, once an application: tasks import it wherever the session was started."""
    context: SparkContext = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="grovewise-py-")) / "grovewise.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _delete_at_end(spark, f"file://{target.parent}")  # the driver serves it until then
    _shipped.add(context.applicationId)
