"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "plinth", **conf: str) -> SparkSession:
    """The running session as it is but for ``conf``, or a new one in UTC with ``conf``."""
    builder = SparkSession.builder.appName(name)
    running = SparkSession.getActiveSession() is not None
    for k, v in (conf if running else {"spark.sql.session.timeZone": "UTC"} | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
