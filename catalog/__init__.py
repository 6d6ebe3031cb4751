"""Registered queries and, next to each, the SQL that must give the same rows."""
