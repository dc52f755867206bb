"""Operators: functions from DataFrames (with dates, thresholds and keys as arguments) to a DataFrame."""
