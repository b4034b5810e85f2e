"""Streams that feed the same table upkeep as batch runs."""
