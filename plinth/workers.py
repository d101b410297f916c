"""Python workers find the package wherever the driver was started."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: The folder that holds the package.
HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``f(spark, ...)`` with the package's folder on the path of the workers of what it returns."""

    @wraps(f)
    def run(spark: SparkSession, *args, **named) -> DataFrame:
        known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if HOME not in known:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, known)])
        return f(spark, *args, **named)

    return run
