"""Schema algebra, null-safe relational verbs, typed casts and ordered-run operators on Spark DataFrames."""
