"""tidewater: conversation moderation and corpus curation on PySpark."""

__version__ = "0.1.0"
