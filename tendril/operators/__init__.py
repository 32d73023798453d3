"""Relational, spatial, graph and field operators on DataFrames."""
