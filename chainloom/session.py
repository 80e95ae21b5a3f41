"""Session settings, the shared folder, and staged tables that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(app: str = "chainloom", cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only where neither is set is an own temporary folder made and registered, and only
    under a local master; a cluster without a shared folder is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.applicationId in _OWN_DIRS:
        return _OWN_DIRS[sc.applicationId]
    given = sc._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("a cluster needs a folder that all executors share: set spark.checkpoint.dir")
    _OWN_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="chainloom-")
    sc.setCheckpointDir(_OWN_DIRS[sc.applicationId])
    return _OWN_DIRS[sc.applicationId]


def ship(spark: SparkSession) -> None:
    """Send the package's code to the executors of a cluster, once for each application."""
    sc = spark.sparkContext
    if sc.master.startswith("local") or sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="chainloom-code-"), "chainloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("chainloom", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the written table.

    Cuts the lineage like a reliable checkpoint, but columnar, pruned on reading and
    compressed. Rows of a plan that isn't deterministic are fixed by it. The folder is
    removed by :func:`unstage` or when the driver ends, the shuffle files of the plan,
    which nothing reads once the table is written, at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chainloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    written._staged_at = path
    _STAGED[path] = spark
    return written


#: Removes a query's shuffle files as soon as it has ended (Spark 4.1 and later; unknown to earlier ones, which keep them until they collect garbage).
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STAGED: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing still to be run depends on."""
    path = getattr(df, "_staged_at", None)
    if path in _STAGED:
        _delete(_STAGED.pop(path), path)


def release() -> None:
    """Delete the staged tables of this driver; results not yet written can't be read afterwards."""
    while _STAGED:
        path, spark = _STAGED.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the JVM is gone, and with it the session
            return


atexit.register(release)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))
