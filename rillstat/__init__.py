"""rillstat: streaming statistics and data-processing operators as Spark DataFrame plans."""

__version__ = "0.1.0"
