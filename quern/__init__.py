"""quern: progressive analytics written as plain functions from DataFrame to DataFrame."""

__version__ = "0.1.0"
