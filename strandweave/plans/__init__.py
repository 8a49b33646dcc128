"""Whole plans: reconstruction end to end, and the registered queries with their SQL twins."""
