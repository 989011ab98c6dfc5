"""Spark jobs for gridded time-series forecasting and probabilistic forecast verification."""
