"""The catalogue of queries that show each operator on the driver's tables."""
