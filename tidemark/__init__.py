"""Dated evidence as DataFrames: as-of slices, weighing, belief ledgers, forecasts and their scoring."""
