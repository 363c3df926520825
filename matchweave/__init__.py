"""Association-graph analytics on Spark: relations in, relations out."""

__version__ = "0.1.0"
