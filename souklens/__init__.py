"""souklens: marketplace product intelligence as PySpark DataFrame jobs."""

__version__ = "0.1.0"
