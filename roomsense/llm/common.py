"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomsense.session import ensure_checkpoint_dir

#: The characters that separate words, as the bodies of a Java / Python character class.
SPACES = r"\x20\x09-\x0D"
#: The same characters, listed, for ``trim`` and ``translate``.
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Arrow's names of the file systems that Spark names otherwise.
_ARROW_SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only a session in one process (tests) may leave it unset: it gets a
    local folder; executors of a cluster would not see one another's."""
    found = ensure_checkpoint_dir(spark)
    if found is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: this operator needs a folder that driver and executors share")
        found = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="roomsense-shared-"))
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody uses; it is deleted when the session's JVM ends."""
    home = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(home)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)   # only what exists can be registered
    files.deleteOnExit(hadoop)
    return f"{home}/data"


def arrow_uri(spark: SparkSession, path: str) -> str:
    """A path as Spark resolves it (a path without a scheme is on the default file system), as a URI that Arrow opens in tasks."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    scheme, _, rest = whole.partition(":")
    if scheme not in _ARROW_SCHEMES:
        raise ValueError(f"files by range need one of the file systems {', '.join(_ARROW_SCHEMES)}; {path} is on {scheme}")
    return f"{_ARROW_SCHEMES[scheme]}://{rest.removeprefix('//')}"


def _filesystem(uri: str):
    from pyarrow import fs

    # a file's path is taken as it is: it may hold signs that a URI would have to escape
    return (fs.LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith("file://") else fs.FileSystem.from_uri(uri)


def open_input(uri: str):
    """A file for reading by range, in a task."""
    system, path = _filesystem(uri)
    return system.open_input_file(path)


def open_output(uri: str):
    """A file for writing from its start, in a task; its folder is made."""
    system, path = _filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)   # bytes as they are, whatever the name ends in


def released(run):
    """A function over a task's batches that hands freed memory back when the task ends.

    A Python worker serves one stage after another; what its allocators keep for themselves would count against the executor's
    memory in all later stages."""
    def whole(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # the GNU C library's alone
        if trim is not None:
            trim(0)
    return whole


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a DataFrame as Parquet into the shared folder and read it back: lineage is cut, rows survive executors."""
    path, names = new_path(df.sparkSession, name), df.columns
    if len({n.lower() for n in names}) < len(names):   # Parquet files cannot hold clashing names
        df = df.toDF(*(f"c{i}" for i in range(len(names))))
    df.write.options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back if df.columns == names else back.toDF(*names)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """``pick(df, id="doc_id")``: only the named columns, renamed.

    A column is found by its exact name first, else without regard to case, and by position, so further columns
    whose names clash (repeated, or equal but for case) do no harm.
    """
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))

    def find(name: str) -> int:
        if name in names:
            return names.index(name)
        return [x.lower() for x in names].index(name.lower())

    return plain.select(*(F.col(f"c{find(name)}").alias(alias) for alias, name in columns.items()))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text):
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
