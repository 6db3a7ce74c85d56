"""feedloom: web pages to structured news feeds, and corpus operators, on PySpark."""

__version__ = "0.1.0"
