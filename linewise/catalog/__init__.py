"""Registered queries over the star tables, and their SQL twins."""
