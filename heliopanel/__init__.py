"""Hourly solar-generation analytics on Spark DataFrames."""
