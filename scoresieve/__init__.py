"""Score-driven data selection on Spark."""
