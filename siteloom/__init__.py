"""Siteloom: website audit and text analytics as Spark dataflows."""

__version__ = "0.1.0"
