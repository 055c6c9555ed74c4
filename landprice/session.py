"""Session defaults for local runs and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}

#: The JVM interprets methods of more bytes, so Spark should not generate them.
METHOD_LIMIT = 8000
_METHOD_SETTING = "spark.sql.codegen.hugeMethodLimit"
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_held: dict[tuple[int, str], tuple[int, str]] = {}
_holding = Lock()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("landprice")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # The 40-column cleaning step compiles to methods the JVM would only interpret;
        # past this size Spark falls back to its split, compilable projections.
        .config(_METHOD_SETTING, str(METHOD_LIMIT))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def _setting(spark: SparkSession, name: str, wanted: Callable[[str], str]) -> Iterator[None]:
    """A session setting for some jobs. The session's own value is put back when the last of the jobs
    that run at the same time is done."""
    key = (spark._jsparkSession.hashCode(), name)
    with _holding:
        users, own = _held.get(key, (0, spark.conf.get(name)))
        _held[key] = (users + 1, own)
        spark.conf.set(name, wanted(own))
    try:
        yield
    finally:
        with _holding:
            users, own = _held.pop(key)
            if users > 1:
                _held[key] = (users - 1, own)
            else:
                spark.conf.set(name, own)


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs over the register's 42 columns, in any session: none of their methods is interpreted.

    Past the limit Spark takes its split projections.
    """
    with _setting(spark, _METHOD_SETTING, lambda own: str(min(int(own), METHOD_LIMIT))):
        yield


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs that shuffle whole tables: the files of a shuffle go when its job ends.

    They would stay until the driver happens to collect its garbage, and those of one step after the
    other would add up on the disks. Not for frames that are run more than once.
    """
    with _setting(spark, _CLEANUP_SETTING, lambda own: "true"):
        yield


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which every executor must see.

    A local session, where driver and executors are one process, gets a folder if none is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if context.applicationId not in _local_scratch:
            _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="landprice-")
        base = _local_scratch[context.applicationId]
    return f"{base.rstrip('/')}/landprice/{kind}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """The same rows read back from the shared scratch folder, with a short lineage."""
    path = scratch_path(df.sparkSession, kind)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark reads; none if it does not exist."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return []
    return sorted(entry.getPath().getName() for entry in files.listStatus(place))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or anything that fits its pattern, is there."""
    place, files = _place(spark, path)
    return bool(files.globStatus(place))


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Size of all files below a folder."""
    place, files = _place(spark, path)
    return files.getContentSummary(place).getLength()


def make_folder(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.mkdirs(place)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders whose rows are no longer needed."""
    for path in paths:
        place, files = _place(spark, path)
        files.delete(place, True)


def discard_rows(df: DataFrame) -> None:
    """Delete what ``materialised`` wrote."""
    files = df.inputFiles()
    discard(df.sparkSession, *{file.rsplit("/", 1)[0] for file in files})
