"""Tessera: k-mer analytics and relational sequence operators as PySpark plans."""

__version__ = "0.1.0"
