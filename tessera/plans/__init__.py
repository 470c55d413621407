"""Named queries over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalogue, codecs, containers, files, forensics, formats, manage, signals, streams, values

QUERIES = catalogue.QUERIES | containers.QUERIES | formats.QUERIES | values.QUERIES | manage.QUERIES | signals.QUERIES | codecs.QUERIES | files.QUERIES | forensics.QUERIES | streams.QUERIES
ORACLES = catalogue.ORACLES | containers.ORACLES | formats.ORACLES | values.ORACLES | manage.ORACLES | signals.ORACLES | codecs.ORACLES | files.ORACLES | forensics.ORACLES | streams.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["search_samples"](spark, sf_dir)
