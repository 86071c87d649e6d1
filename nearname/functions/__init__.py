"""Column functions: names, addresses, distances, records, time."""
