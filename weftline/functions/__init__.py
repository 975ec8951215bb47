"""Driver-side functions: names, types, scalar conversions, hashes."""
