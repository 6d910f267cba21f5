"""Message-schema discovery over logs, as Spark jobs."""

__version__ = "0.1.0"
