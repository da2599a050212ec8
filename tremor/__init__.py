"""Output-only modal analysis of multi-channel time series on Spark."""
