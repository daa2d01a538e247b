"""Operators: functions from DataFrames and explicit parameters to a DataFrame."""
