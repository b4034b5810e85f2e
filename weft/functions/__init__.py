"""Spreadsheet-style functions as native Column expressions, by group: logic, operators, maths, text, dates, windows, base.

Arguments are Columns or column names where noted as ``c``; plain Python values become literals.
"""
