"""Spark sessions set up for the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions import sql_functions

#: What the engine relies on; everything else is the cluster's choice.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Settings and SQL functions for an existing session; may be called any number of times."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    sql_functions.register(spark)
    return spark


def session(name: str = "lodestream", **settings: str) -> SparkSession:
    return configure(SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate())
