"""Sensor time-series analytics on Spark: every operator takes and returns DataFrames."""
