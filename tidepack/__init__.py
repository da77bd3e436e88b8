"""tidepack: adaptive, lossless time-series compression as Spark DataFrame operators."""

__version__ = "0.1.0"
