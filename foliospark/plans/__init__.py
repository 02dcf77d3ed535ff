"""Plans: the operation catalog, and queries that apply operators to tables."""
