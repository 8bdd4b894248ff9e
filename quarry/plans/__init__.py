"""Operators wired into whole analyses, and the registered queries with their SQL twins."""
