"""Values, casts and scalar functions, for single values and as columns."""
