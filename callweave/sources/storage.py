"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_RECORDED: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the context's checkpoint folder.

    Where neither is set, a local master gets a folder of its own; a cluster gets an error, because executors would write
    to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file:///tmp/checkpoints/{app}"
    return _OWN[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; inside :func:`scratch` it is noted."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _RECORDED:
        _RECORDED[-1].append(path)
    return path


def stored(rows: DataFrame, label: str, by: str | None = None, **options: str) -> DataFrame:
    """``rows`` as a table written to the shared folder and read again: cuts the lineage and survives lost executors. ``by``
    names a column whose values get folders of their own."""
    path = fresh_path(rows.sparkSession, label)
    rows.write.options(**options).partitionBy(*[by] if by else []).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a folder once nothing reads it any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists; any other trouble with the storage is an error, not a no."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it does not exist."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file; False if there is one already. Of several that try at once one succeeds, as far as the file
    system's own creation is exclusive; on a local disk it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getScheme() == "file":
        local = Path(target.toUri().getPath())
        local.parent.mkdir(parents=True, exist_ok=True)
        try:
            with local.open("x") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = files.create(target, False)
    except Py4JJavaError as error:
        if files.exists(target):
            return False
        raise error
    out.write(bytearray(text.encode()))
    out.close()
    return True


def pieces_of(spark: SparkSession, path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, some at a time."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        while piece := bytes(stream.readNBytes(size)):
            yield piece
    finally:
        stream.close()


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return b"".join(pieces_of(spark, path)).decode()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the intermediate tables made inside it. What is still to be read must be written elsewhere first."""
    _RECORDED.append([])
    try:
        yield
    finally:
        for path in _RECORDED.pop():
            delete_path(spark, path)
