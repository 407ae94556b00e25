"""Spark ML training, scoring, explanation and forecasting."""
