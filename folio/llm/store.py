"""Tables kept between the jobs of one operator.

Executors can be lost, so lineage is cut only by tables in the folder that the
whole cluster shares (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete the shuffle files of a query when it ends, rather than when the driver's memory is next cleared.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Paths of the tables that are there, in the order in which they were written.
_made: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a temporary one on a single machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="folio-")
    return _local[app]


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table; the shuffle files of the write go with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    own = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if own is None else spark.conf.set(CLEANUP, own)
    _release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    _made[path] = None
    return out


def _release(spark: SparkSession) -> None:
    """Have the driver's JVM collect garbage if it has taken more than half of what it may.

    Tables that ended joins have sent to all tasks, and plans, go from the driver
    (and the executors) only then; an operator of many small jobs piles them up.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > runtime.maxMemory() // 2:
        runtime.gc()


def kept_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``kept(make(), name)``, and then without the tables that ``make`` has left for its result to read."""
    before = set(_made)
    out = kept(make(), name)
    for path in [p for p in _made if p not in before and p != _paths[out]]:
        _delete(out.sparkSession, path)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete kept tables that nothing reads any more; what isn't a kept table is left alone."""
    for table in tables:
        path = _paths.pop(table, None) if table is not None else None
        if path:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    _made.pop(path, None)
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
