"""Session settings.  On a cluster the session is given; these are for tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str, cores: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # call-site capture costs several round trips per Column; the plans have thousands of them
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession, fallback: str | None = None) -> str:
    """Folder all executors share, for checkpoints and saved stages.

    The session's own ``spark.checkpoint.dir`` comes first; the fallback is for sessions without it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return root.rstrip("/")
