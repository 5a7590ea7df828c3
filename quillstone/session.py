"""Session helper: every test, bench run and notebook gets its settings here."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution; on a cluster, spark-submit's settings win.

    ``conf`` holds further settings with ``__`` for each dot (``spark__driver__memory="8g"``).
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("spark__driver__memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
