"""Operators: functions from DataFrames to DataFrames. Tables are described in README.md."""
