"""Registered queries: operators applied to the tables, with their SQL."""
