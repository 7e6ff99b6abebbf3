"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. All are runtime SQL settings, so an existing
# session can take them.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot entity is split even when a later aggregation needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffle files go when the query that wrote them ends: steps are reread from tables, never from shuffles.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

_LOCAL_ROOTS: dict[str, str] = {}


def build(app_name: str = "cohortloom", master: str | None = None, **settings: str) -> SparkSession:
    """A new session with the settings the operators rely on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a session of a single process (``local[n]``) without that setting gets a temporary
    folder; ``local-cluster`` and every cluster need the setting.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app_id = spark.sparkContext.applicationId
    if app_id not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app_id] = tempfile.mkdtemp(prefix="cohortloom-")
    return _LOCAL_ROOTS[app_id]


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path under the shared folder."""
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table", **options: object) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``options`` are those of the writer.

    Cuts the lineage on storage that outlives executors, computes a reused
    result once, and gives Catalyst the true size: a small table is then
    broadcast by ``autoBroadcastJoinThreshold``, a large one is sort-merged.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` whose last reader has been written."""
    for table in tables:
        files = table.inputFiles()
        if files:
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once no result that reads them is needed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
