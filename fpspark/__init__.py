"""fpspark: exact similarity search over binary fingerprints, as Spark plans."""

__version__ = "0.1.0"
