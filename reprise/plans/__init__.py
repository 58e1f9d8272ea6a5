"""Registered queries: plans over the tables, and their SQL twins."""
