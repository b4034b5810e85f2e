"""The registered queries of the table operators, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_formulas, catalog_scale, catalog_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = catalog_formulas.QUERIES | catalog_tables.QUERIES | catalog_scale.QUERIES
ORACLES: dict[str, str] = catalog_formulas.ORACLES | catalog_tables.ORACLES | catalog_scale.ORACLES
FLAGSHIP = "example_brand_revenue"
