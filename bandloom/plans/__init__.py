"""Registered queries over the fixture tables, with their SQL."""
