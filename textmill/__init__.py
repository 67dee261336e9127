"""textmill: corpus curation and experiment analytics as PySpark plans."""

__version__ = "0.1.0"
