"""Trailwarden: continuous compliance analytics over audit events, on PySpark."""

__version__ = "0.1.0"
