"""Declared table flows on Spark: events in, governed layers and KPI tables out."""

__version__ = "0.1.0"
