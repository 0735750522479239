"""Operators over samples, cycle tables, forecasts and metrics; each takes and returns DataFrames."""
