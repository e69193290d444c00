"""Session helper for scripts, benches and tests; queries take any session they are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the SQL results depend on (UTC) and adaptive execution on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexplane")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt over enough tasks for all cores, by its key, before work that is long for a row.

    A compressed table of a few megabytes is read by one or two tasks, however many rows it has.
    """
    spark = df.sparkSession
    return df.repartition(4 * max(8, spark.sparkContext.defaultParallelism), *by)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of this name below the one that driver and executors share (spark.checkpoint.dir), in local mode below a temporary one."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/lexplane-{name}-{uuid.uuid4().hex[:12]}"
