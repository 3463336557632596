"""A Spark engine for personal, multi-source, revision-prone time series."""
