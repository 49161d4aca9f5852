"""A worked sales domain: source views over the given tables, and its specs."""
