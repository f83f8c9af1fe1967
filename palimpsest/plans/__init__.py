"""Registered queries with the SQL they are compared with."""
