"""Dataflow graphs as Spark DataFrames."""
