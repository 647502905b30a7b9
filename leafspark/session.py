"""Session helpers: building a session, the shared checkpoint folder, size checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; set only where it is unset.

    On a cluster an unset folder is an error, as a machine-local folder would not
    survive the loss of an executor; in local mode (tests) a temporary folder serves.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if named:
        return named
    if sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="leafspark-"))
        return sc._jsc.sc().getCheckpointDir().get()
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Cut the lineage with a table written to the shared folder, with a folder for each value of the column by.

    Unlike a checkpointed plan, a table carries no constraints over from the plan that made
    it; those grow with every round of an iterative algorithm. release() drops the table, and
    what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/leafspark/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafspark_path = path
    if not _WRITTEN:
        atexit.register(_sweep, spark)
    _WRITTEN.add(path)
    return out


def read_part(df: DataFrame, by: str, kinds: dict[str, pa.DataType]) -> Callable[[int, list[str]], pa.Table]:
    """A function for Python workers: the columns named of cut(df, by)'s rows with a value of by, in the same order at each call.

    Workers read the files themselves, through pyarrow, so the shared folder must be local or
    on a file system that pyarrow knows (hdfs, s3, gs, abfss).
    """
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(df._leafspark_path)
    uri = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    scheme, plain, named = uri.getScheme(), uri.getPath(), uri.toString()

    def load(value: int, columns: list[str]) -> pa.Table:
        fs, root = (pafs.LocalFileSystem(), plain) if scheme == "file" else pafs.FileSystem.from_uri(named.replace("s3a://", "s3://", 1))
        there = fs.get_file_info(pafs.FileSelector(f"{root}/{by}={value}", allow_not_found=True))
        paths = sorted(f.path for f in there if f.path.endswith(".parquet"))
        schema = pa.schema([(c, kinds[c]) for c in columns])
        # one thread, as a worker has one core
        parts = [pq.ParquetFile(fs.open_input_file(path)).read(columns, use_threads=False).select(columns).cast(schema) for path in paths]
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return load


def release(df: DataFrame) -> None:
    """Delete the table behind a cut frame that nothing reads any more."""
    path = getattr(df, "_leafspark_path", None)
    if path in _WRITTEN:
        _WRITTEN.discard(path)
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _sweep(spark: SparkSession) -> None:
    try:
        for path in _WRITTEN:
            _delete(spark, path)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass
