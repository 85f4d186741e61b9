"""Queries over the shared tables, each with SQL that gives the same rows."""
