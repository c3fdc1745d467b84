"""Scratch tables in the folder that driver and executors share.

``materialize`` cuts lineage by writing a table below ``spark.checkpoint.dir``; a lost
executor then costs a reread, never a recomputation of everything before it. Tables that no
result reads go with the ``passing`` block that they were made in, others when the
interpreter ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; on a local master without one, a new temporary folder.

    On a cluster the setting must be there: a machine-local folder would lose data.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(f"file://{root}")
    return f"file://{root}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    atexit.register(delete_path, spark, path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


#: Paths of the scratch tables of each ``passing`` block that is open, the innermost last.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """A block whose scratch tables are deleted at its end, but for ``lasting`` ones.

    Nothing that is read after the block may read them.
    """
    paths: list[str] = []
    token = _passing.set((*_passing.get(), paths))
    try:
        yield
    finally:
        _passing.reset(token)
        for path in paths:
            delete_path(spark, path)


def materialize(df: DataFrame, label: str, *, lasting: bool = False) -> DataFrame:
    """Write ``df`` to a scratch table and read it back with the same schema.

    Of the innermost ``passing`` block, or of the one around it if the table is ``lasting``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    blocks = _passing.get()[: -1 if lasting else None]
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file appear at ``path`` whole; False, and nothing changes, if it is there.

    Of several writers exactly one wins: the text is written aside and then given its name by
    an operation that fails where the name is taken, a link on local file systems and a rename
    without overwriting (atomic on file systems like HDFS) elsewhere.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    final = hadoop.Path(path)
    fs = final.getFileSystem(conf)
    fs.mkdirs(final.getParent())
    draft = hadoop.Path(final.getParent(), f".draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            paths = spark._jvm.java.nio.file.Paths
            local = lambda p: paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0))
            spark._jvm.java.nio.file.Files.createLink(local(final), local(draft))
        else:
            kind = hadoop.Options.Rename
            options = spark.sparkContext._gateway.new_array(kind, 1)
            options[0] = kind.NONE
            hadoop.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)
    return True


def make_dir(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jpath)


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).open(jpath)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, none where there is no folder; drafts are left out."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []
    return sorted(n for n in found if not n.startswith("."))
