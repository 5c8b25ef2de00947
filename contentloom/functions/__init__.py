"""Expressions of the extraction rules, as Spark SQL text.

Each function takes SQL expressions (a column name is one) and returns one, for use with
``selectExpr`` or ``F.expr``. Rules that nest many calls are parsed by Spark in one go this
way, instead of being put together call by call from Python.
"""
