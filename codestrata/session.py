"""Session settings the library is designed for."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings, not code, decide sizes on a cluster: AQE coalesces and splits shuffle
# partitions from measured bytes. A first plan may broadcast a side whose files are
# estimated below the threshold; later ones go by measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def configured(builder: SparkSession.Builder | None = None, **overrides: str) -> SparkSession:
    """Create (or reuse) a session with the library's settings applied.

    Keyword names use ``__`` for ``.``, e.g. ``spark__sql__shuffle__partitions="8"``.
    """
    builder = builder or SparkSession.builder.appName("codestrata")
    settings = SETTINGS | {name.replace("__", "."): value for name, value in overrides.items()}
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables written between stages.

    A cluster names it in ``spark.checkpoint.dir``; without it the folder is one of the
    warehouse, unless that is on a local disk, which the machines of a cluster do not share.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    on_disk = re.match(r"(?:file:|/|[^:/]+(?:/|\Z))", warehouse)
    if on_disk and not re.match(r"local(?:\[|\Z)", spark.sparkContext.master):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    return f"{warehouse.rstrip('/')}/_stages"


def staged(frame: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, outlives executors."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/stage-{label}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when this process ends; until then results may read it."""
    _temporary.append((spark, path))


_temporary: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove() -> None:
    for spark, path in _temporary:
        try:
            context = spark.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            # A session that was stopped has no settings any more.
            settings = (
                context._jsc.hadoopConfiguration()
                if context._jsc
                else context._jvm.org.apache.hadoop.conf.Configuration()
            )
            target.getFileSystem(settings).delete(target, True)
        except Exception:  # noqa: BLE001 - the process ends anyway
            return
