"""Session construction and the settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "brinework", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, Arrow and UTC; an existing session is returned as it is.

    Partition counts are left to AQE: the initial number only has to be high
    enough, small shuffle partitions are coalesced at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
