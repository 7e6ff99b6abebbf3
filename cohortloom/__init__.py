"""Longitudinal records to modelling tables and risk scores, as Spark DataFrames."""
