"""Registered queries and the SQL they are checked against."""
