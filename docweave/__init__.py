"""docweave: declarative denormalised documents, kept current and searched, on Spark."""

__version__ = "0.1.0"
