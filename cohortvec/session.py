"""Session settings and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Run-time settings every job of this package relies on.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # also split a skewed join whose output feeds an aggregate on the same key
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # rows of a few keys compress so well that the default of 64 MB makes a task hold 1 GB
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_folders: dict[str, str] = {}


def build_session(
    app_name: str = "cohortvec", master: str | None = None, settings: dict[str, str] | None = None
) -> SparkSession:
    """Session with the run-time settings and any further ``settings``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return apply_settings(builder.getOrCreate())


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may run without the setting; it gets a temporary
    folder of this machine, as in tests.  On a cluster the folder must be visible to every executor, so a
    missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="cohortvec-")
    return _local_folders[context.applicationId]


@dataclass(frozen=True)
class Stored:
    """A written intermediate table."""

    df: DataFrame
    path: str

    def discard(self) -> None:
        """Remove the files once nothing reads the table any more."""
        spark = self.df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        target.getFileSystem(conf).delete(target, True)


# Folders of the scopes that are open, innermost last, by application.
_scopes: dict[str, list[str]] = {}


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used."""
    application = spark.sparkContext.applicationId
    scope = "".join(f"/{name}" for name in _scopes.get(application, []))
    return f"{shared_folder(spark)}/{application}{scope}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str, partition_by: str | None = None) -> Stored:
    """Write ``df`` as parquet below the shared folder and read it back.

    This cuts lineage, survives lost executors, keeps column pruning and gives
    Catalyst true file sizes, so that its own size limit decides on broadcasts.
    A filter on the ``partition_by`` column reads only its own files.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path).select(*df.columns), path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables stored inside are removed on exit, but for those given to ``keep``.

    Use a result that reads such tables inside the scope, or keep it.  Scopes
    may be nested; threads started inside store into the same scope.
    """
    scopes = _scopes.setdefault(spark.sparkContext.applicationId, [])
    parent = new_path(spark, "kept")
    name = f"scope-{uuid.uuid4().hex}"
    scopes.append(name)
    folder = new_path(spark, "x").rpartition("/")[0]
    try:
        yield Scratch(parent)
    finally:
        scopes.remove(name)
        Stored(spark.range(0), folder).discard()


@dataclass(frozen=True)
class Scratch:
    parent: str

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` written where it outlives the scope."""
        path = f"{self.parent}-{label}-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_stored(spark: SparkSession) -> None:
    """Remove all intermediate tables this application has written."""
    Stored(spark.range(0), f"{shared_folder(spark)}/{spark.sparkContext.applicationId}").discard()


# Bytes of an Arrow batch that goes to Python, for rows with long arrays.
ARROW_BYTES = 8 * 1024 * 1024
ARROW_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_arrow_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches; a smaller setting stays.

    Batches are otherwise cut by rows alone, and both the JVM and Python hold a
    batch several times over.  A result is computed after the operator has
    returned, so the setting stays with the session.
    """
    said = spark.conf.get(ARROW_BYTES_SETTING).lower()
    number = said.rstrip("bkmgtp")
    size = int(number) * 1024 ** " kmgtp".index(said[len(number) :].rstrip("b") or " ")
    if size <= 0 or size > ARROW_BYTES:
        spark.conf.set(ARROW_BYTES_SETTING, ARROW_BYTES)


def parallelism(spark: SparkSession) -> int:
    """Number of tasks worth creating for compute-heavy steps."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
