"""Session settings that the operators expect."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def builder(app: str = "skein", master: str | None = None, partitions: int | None = None) -> SparkSession.Builder:
    """A session builder; ``partitions`` is the number of shuffle partitions, else the cluster's own setting."""
    made = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        made = made.config(key, value)
    if master:
        made = made.master(master)
    if partitions:
        made = made.config("spark.sql.shuffle.partitions", str(partitions))
    return made


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only where none is named, as in tests."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-shared-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame, dealt: bool = False) -> DataFrame:
    """Cuts the lineage with a copy in the shared folder, which survives lost executors.

    ``dealt``: plans that read the copy know how its rows are dealt, so keys that are together are not dealt again.
    Adaptive plans hide that, hence the copy is planned without; ``df`` should come from an explicit ``repartition``.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if not dealt:
        return df.checkpoint()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files and copies of DataFrames that nothing refers to any more.

    Spark's cleaner does so after the driver's garbage collection, which a driver with little to do puts off for long.
    """
    spark.sparkContext._jvm.System.gc()
