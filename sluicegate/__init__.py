"""Data-quality gates, drift tests and reproducible model releases as Spark DataFrame operators."""

__version__ = "0.1.0"
