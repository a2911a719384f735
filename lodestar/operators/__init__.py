"""Operators on DataFrames: facets, grouping, graphs, stage pipelines."""
