"""Hiring analytics on Spark: reporting, search, scoring, stage transitions, text work and governance as lazy DataFrames."""
