"""Tarmacade: a PySpark-native search and analytics engine for rally data."""

__version__ = "0.1.0"
