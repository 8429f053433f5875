"""Session helpers: reading tables, and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

_STAGED: list[tuple[SparkSession, str]] = []
_READY: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Give this package to the executors, where it need not be installed. Done once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _READY:
        return
    _READY.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(_put(spark, packed.getvalue(), f"quizlake-{uuid.uuid4().hex}.zip"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data set in ``sf_dir``."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it is read in fewer parts than would keep all cores busy.

    For small inputs whose texts take long to work on; a large input has parts enough and is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(3 * cores) if df.rdd.getNumPartitions() < 2 * cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder which all executors share: ``spark.checkpoint.dir``.

    Only a local session (tests, bench) may have it unset; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder which all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quizlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The plan behind it is run once, survives lost executors, and later readers prune columns.
    The files go when the session's Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def at_least_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it, shuffles start from n parts at least. They stay the engine's own, so it may still join small ones and split
    skewed ones, which it leaves alone if a number of parts was asked for by ``repartition``. For plans that run inside."""
    name = "spark.sql.shuffle.partitions"
    old = spark.conf.get(name)
    if n > int(old):
        spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def _put(spark: SparkSession, data: bytes, name: str) -> str:
    """Write a file into the shared folder; returns its full address, with its scheme."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    uri = files.makeQualified(path).toString()
    _STAGED.append((spark, uri))
    return uri


def ship(spark: SparkSession, data: bytes, label: str) -> str:
    """Put ``data`` into the shared folder and have every executor fetch it; returns the name for ``local_path``."""
    name = f"{label}-{uuid.uuid4().hex}"
    spark.sparkContext.addFile(_put(spark, data, name))
    return name


def local_path(name: str) -> str:
    """On an executor: the local copy of what ``ship`` sent."""
    return SparkFiles.get(name)


@atexit.register
def _clean() -> None:
    for spark, uri in _STAGED:
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be gone already
            pass
    _STAGED.clear()
