"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`).

    Only where the session names none and all of it runs on this machine, as in tests, a folder of our own is set; on a cluster
    a folder that every executor can reach has to be named.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        named = tempfile.mkdtemp(prefix="panelshift-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it from there.

    What follows starts from the table: plans stay short, only needed columns are read again, and lost executors cost no
    recomputation. The application owns its tables: `drop_intermediates` or the end of a `scratch` block removes them, and so
    does the end of the application.
    """
    path = intermediate_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def intermediate_path(spark: SparkSession, suffix: str = "") -> str:
    """A new path in the shared folder, removed like the tables of `cut_lineage`."""
    path = f"{shared_folder(spark)}/panelshift-{uuid.uuid4().hex}{suffix}"
    _written.append(path)
    return path


def drop_intermediates(spark: SparkSession, since: int = 0) -> None:
    """Remove the intermediate tables of this application, from the `since`-th on; results not yet stored that read them are lost."""
    _drop(spark.sparkContext, since)


def _drop(context: SparkContext | None, since: int = 0) -> None:
    paths = [_written.pop() for _ in range(len(_written) - since)]
    if context is None or context._jsc is None:  # the context has ended before the application
        return
    with suppress(Exception):  # the folder's owner clears what is left
        for path in paths:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


atexit.register(lambda: _drop(SparkContext._active_spark_context))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside the block go at its end; store or show results before."""
    since = len(_written)
    try:
        yield
    finally:
        drop_intermediates(spark, since)


def ship_package(spark: SparkSession) -> None:
    """Give the package to Python workers that don't find it on their path; the driver serves the archive, once per application.

    The archive holds code only and lies in a temporary folder of the driver, from where Spark itself sends it to the workers.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="panelshift-")) / "panelshift.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
