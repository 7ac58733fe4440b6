"""Composite jobs, the query catalog over the test tables, and its SQL twins."""
