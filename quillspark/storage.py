"""Where intermediate tables go: the folder every executor shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Paths that an application was given, in their order.
_MADE: dict[str, list[str]] = {}
#: Rows of small columns that are worth a file, and so a task, of their own.
ROWS_A_FILE = 50_000


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one of this process only where it is unset.

    The fallback is for tests and single machines. A cluster must set the configuration, as its
    executors do not see the driver's folders; there it is an error to leave it unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        path = tempfile.mkdtemp(prefix="spark-quill-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL[app] = f"file://{path}"
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below :func:`shared_root` that no other call gets."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables that operators write inside, once their results have been used.

    Results are lazy and read these tables, so write or collect them before the end. Nested uses each clear their own.
    """
    made = _MADE.setdefault(spark.sparkContext.applicationId, [])
    kept = len(made)
    try:
        yield
    finally:
        for path in made[kept:]:
            remove(spark, path)
        del made[kept:]


def files_for(rows: int) -> int:
    """In how many files, tasks or buckets about so many rows are kept."""
    return max(1, -(-rows // ROWS_A_FILE))


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts lineage: what follows reads replicated files, so a lost executor costs only its own
    tasks. Writing columns is also smaller than an RDD checkpoint, which holds serialised rows. A caller that
    knows about how many ``rows`` there are, of ids and hashes, says so: the last stage then has a task and a
    file for each ``ROWS_A_FILE`` of them, instead of as many small files as shuffle partitions.
    """
    return materialise_at(df, name, rows)[0]


def materialise_at(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """As :func:`materialise`, with the path, for a caller that removes the table once it is used up."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(files_for(rows))
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def matching(spark: SparkSession, path: str) -> list[str]:
    """The files and folders that a path or pattern fits, on any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return [f.getPath().toString() for f in found] if found is not None else []


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder, or any that a pattern fits, is there."""
    return bool(matching(spark, path))


def move(spark: SparkSession, path: str, to: str) -> None:
    """Rename a file or folder within its store."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).rename(at, jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"{path} cannot become {to}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table through Hadoop's file system, so it works on any store."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
