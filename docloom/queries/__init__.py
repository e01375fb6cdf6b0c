"""Registered queries by operator family, each with the SQL that it is checked against."""
