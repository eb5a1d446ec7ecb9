"""Whole runs, the registered queries and the SQL they are held against."""
