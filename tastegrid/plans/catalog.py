"""Loads the modules that register queries, and the flagship plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..registry import QUERIES
from . import aggregates, chain, commands, extras, filters, joins, looks, models, probes, scalars, sidecars, upserts, windows

MODULES = (aggregates, chain, commands, extras, filters, joins, looks, models, probes, scalars, sidecars, upserts, windows)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rank_scores"](spark, sf_dir)
