"""Operators: functions from DataFrames to a DataFrame; none of them collects rows."""
