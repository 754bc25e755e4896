"""Operators over dated evidence; each takes and gives DataFrames."""
