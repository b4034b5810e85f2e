"""weft: table transformations, spreadsheet formulas and table upkeep as plain Spark DataFrame jobs."""
