"""Analytics of agent sessions on Spark: many log formats to one ordered event table, and the operators over it."""

__version__ = "0.1.0"
