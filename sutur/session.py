"""Session helpers: table loading, shared-folder materialisation, partition sizing."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sutur.errors import ConfigurationError

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package once per application, so they need no copy on their path."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="sutur-package-")
    archive = os.path.join(folder, "sutur.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for root, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(root, name)
                    out.write(path, os.path.join("sutur", os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of the test-data layout (a file or a directory)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in local
    tests, a temporary folder of this machine is used and set for the session; on a cluster it fails.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context.get() if context.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "sutur-shared-" + uuid.uuid4().hex)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _kept_until_the_end(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    The files are on storage that outlives any executor, are columnar (later reads prune
    columns) and are deleted when the application ends.
    """
    return materialize_all(df.sparkSession, [df], df.schema, name)


def materialize_all(spark: SparkSession, frames: Iterable[DataFrame], schema: StructType | str, name: str) -> DataFrame:
    """All rows of ``frames`` as one table, as ``materialize`` does it; each frame is written before the next is asked for."""
    path = f"{shared_dir(spark)}/sutur/{name}-{uuid.uuid4().hex}"
    number = -1
    for number, df in enumerate(frames):
        df.write.mode("append" if number else "errorifexists").parquet(path)
    if number < 0:
        return spark.createDataFrame([], schema)
    _kept_until_the_end(spark, path)
    return spark.read.schema(schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a ``materialize`` result that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    roots = {os.path.dirname(f) for f in df.inputFiles()}
    for root in roots:
        if "/sutur/" in root:
            hadoop_path = jvm.org.apache.hadoop.fs.Path(root)
            hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain_strings(rows):
    """A pandas frame whose string columns are plain objects.

    Strings of a group that came in several Arrow batches are chunked, which the way back to the
    JVM does not take.
    """
    return rows.astype({c: object for c, kind in rows.dtypes.items() if str(kind) in ("str", "string")})
