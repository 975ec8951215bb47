"""Relational verbs, casts, group functions and ordered operators on DataFrames."""
