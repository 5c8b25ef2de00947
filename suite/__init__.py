"""Registered queries: each runs an operator over whole driver tables, with SQL to check it by.

Where the tables lack a shape (hub pages, listings, threads), the query derives it from
them by expressions that both engines read the same way.
"""
