"""Composed plans: model runs, table upkeep and the registered queries."""
