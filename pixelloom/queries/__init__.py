"""Registered queries of the pixel operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog, colour_q, program_q, region_q, window_q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.ORACLES)


__all__ = ["colour_q", "oracle_sql", "program_q", "queries", "region_q", "window_q"]
