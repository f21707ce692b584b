"""Hierarchical time-series forecasting and scoring as Spark DataFrame operators."""
