"""The Spark session the engine's own entry points use."""

from pyspark.sql import SparkSession

from creditloom.sources import layout


def build_session(app: str = "creditloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC dates and adaptive execution on; conf holds further settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        layout.ORDERED: "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
