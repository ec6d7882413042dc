"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this library relies on; callers may override any of them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # let AQE coalesce the small shuffles of cached intermediate results too
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def ship_by_value(module_name: str) -> None:
    """Pickle the functions of ``module_name`` by value, so Python workers that cannot import
    this package (it need not be installed on the cluster) still run its pandas functions."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def get_session(master: str | None = None, app: str = "spanrules",
                conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the folder is set by the deployment and only read here; unset on a cluster is an
    error. In local mode (tests) an unset folder is replaced by a fresh one, once per session.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors "
                               "(checkpoints and staged tables are written there)")
        configured = tempfile.mkdtemp(prefix="spanrules-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_PARQUET_BAD = set(" ,;{}()\n\t=")


def _parquet_safe(schema) -> bool:
    from pyspark.sql import types as T

    def ok(dt) -> bool:
        if isinstance(dt, T.StructType):
            return all(not (set(f.name) & _PARQUET_BAD) and ok(f.dataType) for f in dt.fields)
        if isinstance(dt, T.ArrayType):
            return ok(dt.elementType)
        if isinstance(dt, T.MapType):
            return ok(dt.keyType) and ok(dt.valueType)
        return True

    return ok(schema)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and continue from there.

    Written as a parquet table and read back: one job, and later scans get column pruning. (A
    reliable ``Dataset.checkpoint`` runs the plan twice, once to count and once to write.)
    Column names parquet cannot store fall back to persist + reliable checkpoint. Either way
    the data survives the loss of executors, unlike a local checkpoint.
    """
    spark = df.sparkSession
    if _parquet_safe(df.schema):
        path = scratch_path(spark, f"cut-{uuid.uuid4().hex}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    checkpoint_dir(spark)
    kept = df.persist()
    out = kept.checkpoint(eager=True)
    kept.unpersist(blocking=False)
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub folder of the shared checkpoint folder, for tables written between jobs."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)
