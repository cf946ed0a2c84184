"""Operators on DataFrames: joins, aggregates, ranking, pools, governance, splits, learning, screening."""
