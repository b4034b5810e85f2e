"""Where jobs keep versioned tables of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from weft.shared import shared_dir

from .upkeep import Table


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder."""
    return f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"


def scratch_table(spark: SparkSession) -> Table:
    return Table(spark, scratch(spark))
